"""Packing: concatenate all documents' ids and cut them into fixed windows.

Two passes over partitions: the first tokenises, keeps each document's start within its partition and
writes the ids once; the partitions' totals are summed up to the partitions' starts; the second pass
knows each document's place in the whole and cuts it where a window ends. A document over a cut leaves
one boundary record for each window it lies in. Only the last sequence is short; it is padded to the
next power of two, all others are full.

Defined results: a null text counts as empty (the end id alone); repeated documents are packed again, and so are rows
without doc_id; a very long text has pieces in as many sequences as it needs; an empty table gives no sequence; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.subwords import encoder
from tidewatch.llm.token_files import with_end
from tidewatch.llm.words import slices
from tidewatch.sources.scratch import cut

#: Bytes of texts or ids that a task works on and hands on at a time, so that it never holds a whole batch's copies.
SLICE = 1_000_000
_TOKENS = "part long, local_start long, doc_id long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def padded_length(length: int, window: int) -> int:
    """The length that a sequence of so many ids is padded to: the window, or a power of two below it."""
    return min(window, 1 << max(0, length - 1).bit_length())


def _runs(data: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of consecutive runs of rows that hold at most ``SLICE`` bytes (or one row)."""
    start = 0
    for part in slices(data, SLICE):
        yield start, len(part)
        start += len(part)


def pack_documents(docs: DataFrame, window: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        narrow = "<u2" if max(end_id, encode.tokenizer.get_vocab_size() - 1) < 1 << 16 else "<u4"
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for texts in slices(batch.column("text"), SLICE):
                own, doc_ids = doc_ids.slice(0, len(texts)), doc_ids.slice(len(texts))
                ids, counts = with_end(*encode.encode(texts), end_id)
                ends = np.cumsum(counts)
                width = np.dtype(narrow).itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int64).tobytes()), pa.py_buffer(ids.astype(narrow).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part)), pa.array(at + ends - counts), own, pa.array(counts), data], ["part", "local_start", "doc_id", "doc_tokens", "ids"])
                at += int(counts.sum())

    tokens = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, _TOKENS), "packed")
    # One row for each partition of the first pass: 16 bytes for each split of the input.
    totals = dict(tokens.groupBy("part").agg(F.sum("doc_tokens")).collect())
    base, total = {}, 0
    for k in sorted(totals):
        base[k], total = total, total + totals[k]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(a, n) for batch in batches for a, n in _runs(batch.column("ids"))):
            counts = np.asarray(batch.column("doc_tokens"))
            first = np.array([base[k] for k in batch.column("part").to_pylist()], np.int64) + np.asarray(batch.column("local_start"))
            sequence, last = first // window, (first + counts - 1) // window
            n = last - sequence + 1
            row = np.repeat(np.arange(len(counts)), n)
            own = sequence[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin, end = np.maximum(own * window, first[row]), np.minimum((own + 1) * window, (first + counts)[row])
            data, out = batch.column("ids"), []
            kept, ids = -1, None
            for r, a, b in zip(row.tolist(), (begin - first[row]).tolist(), (end - first[row]).tolist(), strict=True):
                if r != kept:
                    raw = data[r].as_py()
                    kept, ids = r, np.frombuffer(raw, "<u2" if len(raw) == 2 * counts[r] else "<u4").astype("<u4")
                out.append(ids[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(begin - first[row]), pa.array(end - begin), pa.array(out, pa.binary()), pa.array(counts[row]), pa.array(own), pa.array(begin - own * window)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(pieces, _PIECES)


def packing_digest(docs: DataFrame, **options) -> DataFrame:
    """The pieces with their ids as crc32."""
    return pack_documents(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
