"""Token-ID files: patched frame-of-reference blocks.

A shard (a range of ``doc_id``) is a run of segments; a segment holds whole documents and is one blob:
a header, the documents' ids and lengths, the block index, the packed blocks and the exceptions. A block
of 512 ids keeps its minimum, the width that 90 of 100 of its differences fit into, and where it
starts; the high bits of differences that need more are in the exception list. Segments are rows of a
Parquet table, so any store that Spark writes to holds them and a write is committed as a whole.

Defined results: a null text counts as empty (the end id alone); repeated ``doc_id``s stay in the order of
their texts; an empty table gives an empty file; other columns are not read. A very long text makes one
long segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.subwords import encoder, gather
from tidewatch.sources.scratch import cut_to, new_path, partitions

BLOCK = 512
#: Tokens after which a segment ends with its current document.
SEGMENT = 1 << 17
_MAGIC = b"TWF1"
_PERCENTILE = 0.9
_SEGMENTS = "shard int, segment long, first_token long, n_tokens long, data binary"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """Packs uint32 ids into blocks; the inverse of ``unpack``."""
    n = len(ids)
    rows = -(-n // BLOCK)
    table = np.full(rows * BLOCK, ids[-1] if n else 0, np.uint32)
    table[:n] = ids
    table = table.reshape(rows, BLOCK)
    low = table.min(axis=1) if rows else np.zeros(0, np.uint32)
    delta = table - low[:, None]
    cutoff = int(_PERCENTILE * (BLOCK - 1))
    width = _bit_length(np.partition(delta, cutoff, axis=1)[:, cutoff]) if rows else np.zeros(0, np.int64)
    size = width * (BLOCK // 8)
    start = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        bits = ((delta[at][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        packed[start[at][:, None] + np.arange(w * (BLOCK // 8))] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    high = delta >> width.astype(np.uint32)[:, None].clip(max=31) if rows else delta
    high[width >= 32] = 0
    where = np.flatnonzero(high)
    head = struct.pack("<III", n, len(packed), len(where))
    return b"".join([head, low.astype("<u4").tobytes(), width.astype("u1").tobytes(), start.astype("<u4").tobytes(), packed.tobytes(), where.astype("<u4").tobytes(), high.ravel()[where].astype("<u4").tobytes()])


def unpack(data: bytes) -> np.ndarray:
    n, n_packed, n_high = struct.unpack_from("<III", data)
    rows, at = -(-n // BLOCK), 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, start = take("<u4", rows), take("u1", rows).astype(np.int64), take("<u4", rows).astype(np.int64)
    packed, where, high = take("u1", n_packed), take("<u4", n_high), take("<u4", n_high)
    delta = np.zeros((rows, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows_w = np.flatnonzero(width == w)
        bits = np.unpackbits(packed[start[rows_w][:, None] + np.arange(w * (BLOCK // 8))], axis=1, bitorder="little").reshape(len(rows_w), BLOCK, w)
        value = np.zeros((len(rows_w), BLOCK), np.uint32)
        for b in range(w):
            value |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
        delta[rows_w] = value
    flat = delta.reshape(-1)
    flat[where] |= high << width[where.astype(np.int64) // BLOCK].astype(np.uint32)
    return (delta + low[:, None]).reshape(-1)[:n]


def write_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    return b"".join([_MAGIC, struct.pack("<q", len(doc_ids)), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), pack(ids)])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, how many ids each has, all ids in a row."""
    if data[:4] != _MAGIC:
        raise ValueError("not a segment of a token file")
    (n,) = struct.unpack_from("<q", data, 4)
    doc_ids, counts = np.frombuffer(data, "<i8", n, 12), np.frombuffer(data, "<i8", n, 12 + 8 * n)
    return doc_ids, counts, unpack(data[12 + 16 * n :])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to each document."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    first = np.cumsum(counts) - counts
    out[gather(first + np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the ids of ``docs(doc_id, text)`` in ascending doc_id order to ``path``. tokenizer: a path or a public file's name."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, segment, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer)
        for batch in batches:
            doc_ids = np.asarray(batch.column("doc_id"))
            ids, counts = with_end(*encode.encode(batch.column("text")), end_id)
            ends, a = np.cumsum(counts), 0
            while a < len(doc_ids):
                base = int(ends[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
                part = ids[base : int(ends[b - 1])]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "segment": [segment], "first_token": [first], "n_tokens": [len(part)], "data": [write_segment(doc_ids[a:b], counts[a:b], part)]})
                segment, first, a = segment + 1, first + len(part), b

    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    ordered = docs.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    cut_to(ordered.mapInArrow(shard, _SEGMENTS), path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32) of each document of a token file."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    # One row a shard (a partition of the writer), so this stays far below the corpus: 16 bytes for each 64 MB.
    totals = dict(segments.groupBy("shard").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for k in sorted(totals):
        base[k], at = at, at + totals[k]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, data in zip(batch.column("shard").to_pylist(), batch.column("first_token").to_pylist(), batch.column("data"), strict=True):
                doc_ids, counts, ids = read_segment(data.as_py())
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": base[shard] + first + ends - counts, "n_tokens": counts, "ids": [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]})

    return segments.select("shard", "first_token", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Writes a token file of the documents and returns what reading it back gives, ids as their crc32."""
    path = new_path(spark, "tokens")
    write_token_file(docs, path, tokenizer, end_id)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
