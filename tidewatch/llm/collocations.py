"""Phrase collocations by relational mining: occurrence relations of growing length, joined, counted and pruned.

The relation of length 1 has a row (lang, piece, position, word) for each word, sorted by piece and position; that of
length k has the places where k words stand. Each is written as a table of chunks: the positions of a chunk are numbers
that grow by one from word to word and by two over the end of a piece, so that neighbours in a piece differ by exactly one; words and phrases
are numbered in the chunk, and ``key`` has their hashes. A chunk holds whole documents, about 2 MB of text, so a
merge-join of neighbouring positions stays within it and no occurrence is ever shuffled.

One step: the relation of length k - 1 is merge-joined with itself at the next position (two phrases that overlap in all but
one word), the joined rows are counted per chunk and then in total, and the rows whose phrase is frequent are kept as the relation of
length k. That semi-join goes by a bitmap of the frequent hashes (``BITS`` bits, whatever the corpus): it may keep a phrase that is
not frequent, never lose one that is, and counts come from the totals alone. A phrase's parts are the phrases that
were joined to it, so its words and the counts of its cuts come by joins of the small tables of frequent phrases.

Defined results: null texts are empty, a null lang is ``und``; rows that repeat count each time, rows need no doc_id; very
long texts are read whole; equal scores are ordered by count, then phrase (UTF-8 bytes), equal cuts by the smaller first
part; languages without a candidate have no row; further columns are not read; an empty table gives an empty one. Words and phrases are
told apart by 64-bit hashes of their language and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.words import LOWER, flat_bytes, mix, range_hashes, slices
from tidewatch.sources.scratch import cut, cut_to, drop, new_path

#: Words of a phrase at most, occurrences at least, rows of each language, and the share (in hundredths) at which a longer phrase stands for a shorter one.
LONGEST, SUPPORT, TOP, COVERED = 4, 30, 2000, 80
#: Bytes of text in a chunk, about, and bits of the map of frequent phrases (16 MB, in words of 64).
CHUNK, BITS = 2_000_000, 1 << 27
#: Chunks that a task writes or reads at once.
CHUNKS = 2
#: Tasks that rank one language before its best rows meet.
SALT = 64

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

_FIRST = "gap binary, code binary, key array<long>, n array<long>, lang array<string>, word array<string>"
_LATER = "gap binary, code binary, key array<long>, first array<long>, rest array<long>"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts; starts and ends of their words; the text of each word; whether a piece begins with it."""
    raw, offsets = flat_bytes(texts)
    raw = LOWER[raw]
    word = ~(_BLANK | _BREAK)[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], word]), np.concatenate([word, [False]])
    starts, ends = np.flatnonzero(after & (edge | ~before)), np.flatnonzero(before & (edge | ~after))
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw], dtype=np.int64)])
    text = np.searchsorted(offsets, starts, "right") - 1
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (breaks[starts[1:]] > breaks[starts[:-1]]) | (text[1:] > text[:-1])
    return raw, starts, ends, text, fresh


def _hash_of(names: list[str]) -> np.ndarray:
    raw, offsets = flat_bytes(pa.array(names, pa.string()))
    return range_hashes(raw, offsets[:-1], offsets[1:])


def _packed(at: np.ndarray, code: np.ndarray) -> tuple[bytes, bytes]:
    """Steps between positions and codes as 32-bit numbers."""
    return np.diff(at, prepend=0).astype("<i4").tobytes(), code.astype("<i4").tobytes()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys."""
    return np.cumsum(np.frombuffer(row["gap"], "<i4").astype(np.int64)), row["key"][np.frombuffer(row["code"], "<i4")]


def _first(chunk_bytes: int):
    """The relation of length 1, a row for each chunk of so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of each slice: keys, starts of pieces; a place of each distinct word, the words, their languages
        size = 0

        def chunk() -> pa.RecordBatch:
            key, fresh = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            distinct, code, n = np.unique(key, return_inverse=True, return_counts=True)
            # each slice has its own words once; the first slice that has a word names it
            one = np.unique(np.concatenate([h[0][h[2]] for h in held]), return_index=True)[1]
            words, langs = (pa.chunked_array([h[i] for h in held]).take(pa.array(one)).combine_chunks() for i in (3, 4))
            row = [*_packed(np.arange(len(key)) + np.cumsum(fresh), code), distinct.view(np.int64), n, langs, words]
            types = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            values = [pa.array([x], t) if i < 2 else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t.value_type) if i < 4 else x.cast(pa.string())) for i, (x, t) in enumerate(zip(row, types, strict=True))]
            return pa.RecordBatch.from_arrays(values, ["gap", "code", "key", "n", "lang", "word"])

        for batch in batches:
            langs = pc.fill_null(batch.column("lang"), "und")
            for texts in slices(batch.column("text"), 400_000):
                own, langs = langs.slice(0, len(texts)), langs.slice(len(texts))
                raw, starts, ends, text, fresh = words_of(texts)
                if not len(starts):
                    continue
                names = own.dictionary_encode()
                lang = np.asarray(names.indices)[text]
                key = mix(range_hashes(raw, starts, ends) + mix(_hash_of(names.dictionary.to_pylist()))[lang])
                at = np.unique(key, return_index=True)[1]
                found = pa.array([raw[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
                held.append((key, fresh, at, found, names.dictionary.take(pa.array(lang[at]))))
                size += len(raw)
                if size >= chunk_bytes:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    return run


def _joined(row: dict, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, keys, first and second part of the neighbours in a chunk whose parts are both frequent."""
    at, key = _unpacked(row)
    kept = _marked(frequent, key)
    at, key = at[kept], key[kept]
    here = np.flatnonzero(at[1:] == at[:-1] + 1)
    first, rest = key[here], key[here + 1]
    return at[here], mix(mix(first) * np.uint64(0x9E3779B97F4A7C15) + rest), first, rest


def _marked(frequent: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(64 * len(frequent) - 1)
    return (frequent[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column("key")[i].values
            yield {"gap": batch.column("gap")[i].as_buffer(), "code": batch.column("code")[i].as_buffer(), "key": np.asarray(key).view(np.uint64)}


def _counts(parts):
    """key, n of the joined rows of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            key, n = np.unique(_joined(row, parts.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


def _kept(parts, phrases):
    """The relation of the next length: joined rows whose phrase is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at, key, first, rest = _joined(row, parts.value)
            own = _marked(phrases.value, key)
            at, key, first, rest = at[own], key[own], first[own], rest[own]
            distinct, one, code = np.unique(key, return_index=True, return_inverse=True)
            gap, code = _packed(at, code)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(x.view(np.int64))) for x in (distinct, first[one], rest[one])]
            yield pa.RecordBatch.from_arrays([pa.array([gap], pa.binary()), pa.array([code], pa.binary()), *lists], ["gap", "code", "key", "first", "rest"])

    return run


def _bitmap(found: DataFrame):
    """Bits of the keys of a table, for all tasks; ``BITS`` / 64 numbers come to the driver at most."""
    place = F.col("key").bitwiseAND(F.lit(BITS - 1))
    bits = found.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(key & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.uint64)
    out[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    return found.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n (all words of a language); and for each length key, a (its count, at least ``support``), and lang, word or first, rest."""
    spark = docs.sparkSession
    path = new_path(spark, "occurrences-1")
    relation = cut_to(docs.select("lang", "text").mapInArrow(_first(CHUNK), _FIRST), path, group_rows=CHUNKS)
    words = relation.select(F.explode(F.arrays_zip("key", "lang", "word", "n")).alias("e")).select("e.*")
    words = cut(words.groupBy("key", "lang", "word").agg(F.sum("n").alias("a")), "words")
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    found = [cut(words.where(F.col("a") >= support), "frequent-1")]
    bits = _bitmap(found[0])
    for k in range(2, longest + 1):
        counts = relation.select("gap", "code", "key").mapInArrow(_counts(bits), "key long, n long")
        counts = cut(counts.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= support), f"counts-{k}")
        more = _bitmap(counts)
        before, path = path, new_path(spark, f"occurrences-{k}")
        relation = cut_to(relation.select("gap", "code", "key").mapInArrow(_kept(bits, more), _LATER), path, group_rows=CHUNKS)
        drop(spark, before)
        parts = relation.select(F.explode(F.arrays_zip("key", "first", "rest")).alias("e")).select("e.*").groupBy("key").agg(F.first("first").alias("first"), F.first("rest").alias("rest"))
        found.append(cut(counts.join(parts, "key"), f"frequent-{k}"))
        bits = more
    drop(spark, path)
    return total, found


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of ``docs(lang, text)``."""
    total, found = frequent_phrases(docs, support, longest)
    # f has the count of each run of words of the phrase: f[i][j] of words i to i + j
    phrases = found[0].select("key", "lang", F.array("word").alias("words"), F.array(F.array("a")).alias("f"))
    candidates = None
    for k in range(2, longest + 1):
        first = phrases.select(F.col("key").alias("first"), "lang", F.col("words").alias("words_l"), F.col("f").alias("f_l"))
        rest = phrases.select(F.col("key").alias("rest"), F.col("words").alias("words_r"), F.col("f").alias("f_r"))
        words = F.concat("words_l", F.array(F.element_at("words_r", -1)))
        # the first word's runs are those of the first part and the whole phrase; all others lie in the rest
        f = F.concat(F.array(F.concat(F.get("f_l", F.lit(0)), F.array("a"))), F.col("f_r"))
        phrases = cut(found[k - 1].join(first, "first").join(rest, "rest").select("key", "lang", "first", "rest", "a", words.alias("words"), f.alias("f")), f"phrases-{k}")
        cuts = []
        for c in range(1, k):
            left, right = F.get(F.get("f", F.lit(0)), F.lit(c - 1)), F.get(F.get("f", F.lit(c)), F.lit(k - c - 1))
            score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * 2000000) div CAST(get(get(f, 0), {c - 1}) + get(get(f, {c}), {k - c - 1}) AS DECIMAL(21,0))")
            cuts.append(F.struct(score.alias("score"), F.lit(c).alias("cut"), left.alias("l"), right.alias("r")))
        own = phrases.select("key", "lang", "a", F.array_join("words", " ").alias("phrase"), F.array_min(F.array(*cuts)).alias("best"))
        if candidates is not None:
            over = phrases.select(F.explode(F.array("first", "rest")).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
            hidden = F.expr(f"CAST(longer AS DECIMAL(20,0)) * 100 >= CAST(a AS DECIMAL(20,0)) * {covered}")
            previous = previous.join(over, "key", "left").where(~F.coalesce(hidden, F.lit(False))).drop("longer")
            candidates = previous if k == 3 else candidates.unionByName(previous)
        else:
            candidates = own
        previous = own
        phrases = phrases.select("key", "lang", "words", "f")
    candidates = previous if longest == 2 else candidates.unionByName(previous)
    rows = cut(candidates.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(SALT)).alias("salt")), "candidates")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
