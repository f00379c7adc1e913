"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes at content-selected positions are kept: in every window of 35 consecutive 16-word grams the one
with the least hash, so each passage of 50 words holds a kept suffix and so does every copy of it. Suffixes
whose gram occurs once are dropped. The others get their context, 34 words before and 50 from the suffix on;
equal contexts are one entry with a count. A match of 50 words is one of the 35 windows of 50 words around the
gram, so every window of every entry is hashed: a window that entries of two documents hold is a match, whatever
else shares parts of it and however often a document repeats itself. An entry's windows overlap in its gram, so its
matches are one passage; passages are merged to maximal ones of each document.

Entries are dealt by their gram and the windows of whole grams are compared in memory. A gram with very many
contexts (a passage that a third of all documents share) is never gathered: its windows are dealt by their hashes.

Defined results: words are lower-cased (A-Z) runs of anything but ASCII white space; documents of fewer than
``MIN_WORDS`` words, null and empty texts have no passage; rows that repeat a ``doc_id`` are one document, whose
own repeats do not count. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.words import _power_tables, mix, slices, word_hashes
from tidewatch.sources.scratch import cut, partitions

MIN_WORDS, GRAM = 50, 16
#: The windows of a gram with more contexts than this are dealt by their hashes.
HOT = 10_000
#: A gram with more than one in so many of all places is common.
COMMON = 1000
_GRAMS = MIN_WORDS - GRAM + 1
_LEFT = MIN_WORDS - GRAM


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) of each n consecutive values."""
    width, out = 1, x
    while 2 * width <= n:
        out = least(out[:-width], out[width:])
        width *= 2
    return least(out[: len(out) - (n - width)], out[n - width :]) if n > width else out


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes among the words of all texts, and their grams' hashes."""
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers, inverses = _power_tables(n)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:n])])
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * inverses[: n - GRAM + 1]) | np.uint64(1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[: n - MIN_WORDS + 1] == text[MIN_WORDS - 1 :]
    least = np.where(inside, _sliding(grams, _GRAMS, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(_GRAMS - 1, np.uint64), least, np.zeros(_GRAMS - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, _GRAMS, np.maximum) == grams)
    return at, grams[at]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        for texts in slices(batch.column("text")):
            own, ids = ids[: len(texts)], ids[len(texts) :]
            words, first = word_hashes(texts)
            at, grams = anchors(words, first)
            text = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(own[text]), pa.array((at - first[text]).astype(np.int32)), pa.array(grams.view(np.int64))], ["doc_id", "at", "gram"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (doc_id, at, context) with the context's words the first time that this task meets it."""
    seen: set[int] = set()
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        places = batch.column("places")
        for texts in slices(batch.column("text")):
            own, ids = ids[: len(texts)], ids[len(texts) :]
            mine, places = places.slice(0, len(texts)), places.slice(len(texts))
            words, first = word_hashes(texts)
            count = np.asarray(pa.compute.list_value_length(mine), np.int64)
            text = np.repeat(np.arange(len(own)), count)
            local = np.asarray(mine.flatten(), np.int64)
            if not len(local):
                continue
            span = local[:, None] + np.arange(-_LEFT, MIN_WORDS)
            valid = (span >= 0) & (span < np.diff(first)[text][:, None])
            index = np.where(valid, span + first[:-1][text][:, None], 0)
            short = np.where(valid, (words[index] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
            wide = np.where(valid, words[index], np.uint64(0))
            weights = mix(np.arange(1, wide.shape[1] + 1, dtype=np.uint64))
            context = mix((mix(wide + np.uint64(7)) * weights).sum(axis=1)).view(np.int64)
            gram = mix((mix(wide[:, _LEFT : _LEFT + GRAM]) * weights[:GRAM]).sum(axis=1)).view(np.int64)
            new = np.array([k not in seen and not seen.add(k) for k in context.tolist()])
            if len(seen) > 1_000_000:
                seen.clear()
            left = np.ascontiguousarray(short[:, :_LEFT][:, ::-1]).astype(">u4")
            right = np.ascontiguousarray(short[:, _LEFT:]).astype(">u4")
            columns = [pa.array(own[text]), pa.array(local.astype(np.int32)), pa.array(context), pa.array(gram)]
            columns += [pa.array([x.tobytes() if k else None for x, k in zip(side, new, strict=True)], pa.binary()) for side in (left, right)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "context", "gram", "left", "right"])


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each entry's windows that begin 0, 1, ... words before its suffix, and which lie inside the text."""
    sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").reshape(batch.num_rows, -1) for k in ("left", "right")]
    words = np.concatenate([sides[0][:, ::-1], sides[1]], axis=1).astype(np.uint64)
    powers, inverses = _power_tables(words.shape[1])
    prefix = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    np.cumsum(mix(words) * powers[: words.shape[1]], axis=1, out=prefix[:, 1:])
    start = _LEFT - np.arange(_LEFT + 1)
    keys = mix((prefix[:, start + MIN_WORDS] - prefix[:, start]) * inverses[start])
    return keys, (words[:, start] > 0) & (words[:, start + MIN_WORDS - 1] > 0)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches in entries sorted by gram: context, words before and from the suffix on, smallest document that shares a part."""
    held: list[pa.RecordBatch] = []

    def matches(entries: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in entries.combine_chunks().to_batches():
            keys, valid = _windows(batch)
            entry, before = np.nonzero(valid)
            _, key = np.unique(keys[valid], return_inverse=True)
            n = int(key.max()) + 1 if len(key) else 0
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(low, key, np.asarray(batch.column("low"))[entry])
            np.maximum.at(high, key, np.asarray(batch.column("high"))[entry])
            shared = (low < high)[key]
            entry, before, least = entry[shared], before[shared], low[key[shared]]
            if len(entry):
                at = np.flatnonzero(np.diff(entry, prepend=-1))
                columns = [batch.column("context").take(pa.array(entry[at])), pa.array(np.maximum.reduceat(before, at).astype(np.int32))]
                columns += [pa.array((MIN_WORDS - np.minimum.reduceat(before, at)).astype(np.int32)), pa.array(np.minimum.reduceat(least, at))]
                yield pa.RecordBatch.from_arrays(columns, ["context", "before", "after", "low"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # The last gram of a batch may go on in the next one.
        gram = np.asarray(batch.column("gram"))
        last = int(np.searchsorted(gram, gram[-1]))
        ended = held and held[-1].column("gram")[-1].as_py() != gram[0]
        if last or ended:
            yield from matches(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from matches(pa.Table.from_batches(held))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each entry: key, context, words before the suffix, smallest and largest document."""
    for whole in batches:
        for a in range(0, whole.num_rows, 2000):
            batch = whole.slice(a, 2000)
            keys, valid = _windows(batch)
            entry, before = np.nonzero(valid)
            own = batch.select(["context", "low", "high"]).take(pa.array(entry))
            yield pa.RecordBatch.from_arrays([pa.array(keys[valid].view(np.int64)), own.column("context"), pa.array(before.astype(np.int8)), own.column("low"), own.column("high")], ["key", "context", "before", "low", "high"])


def _hot_matches(entries: DataFrame) -> DataFrame:
    """As ``_compare``, for entries of grams that are too common for one task."""
    windows = entries.mapInArrow(_dealt, "key long, context long, before byte, low long, high long")
    shared = windows.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key", "low")
    found = windows.select("key", "context", "before").join(shared, "key").groupBy("context")
    return found.agg(F.max("before").cast("int").alias("before"), (MIN_WORDS - F.min("before")).cast("int").alias("after"), F.min("low").alias("low"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, first_doc_id: maximal passages that another document also holds.

    ``first_doc_id`` is the smallest document known to hold a part of the passage.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    kept = cut(docs.mapInArrow(_kept, "doc_id long, at int, gram long"), "kept")
    # Grams of two documents. One that has over a thousandth of all places is common: there are under a thousand of them,
    # so they are marked by broadcast, and the others are joined without any group that one task could not hold.
    grams = kept.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    grams = cut(grams.where("low < high").select("gram", "n"), "grams")
    common = grams.where(F.col("n") * COMMON > kept.count()).select("gram", F.lit(True).alias("common"))
    kept = kept.join(F.broadcast(common), "gram", "left")
    rare = kept.where("common is null").join(grams.select("gram"), "gram", "left_semi")
    kept = kept.where("common").select("doc_id", "at").unionByName(rare.select("doc_id", "at"))
    places = kept.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("places"))
    members = docs.join(places, "doc_id").mapInArrow(_contexts, "doc_id long, at int, context long, gram long, left binary, right binary")
    members = cut(members, "suffixes")
    counts = members.groupBy("context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    entries = members.where(F.col("left").isNotNull()).select("context", "gram", "left", "right").dropDuplicates(["context"]).join(counts, "context")
    hot = entries.groupBy("gram").count().where(F.col("count") > HOT).select("gram", F.lit(True).alias("hot"))
    entries = cut(entries.join(hot, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "entries")
    n = partitions(entries)
    # Sorted by gram, so that a task holds one gram at a time.
    ordered = entries.where(~F.col("hot")).repartition(n, "gram").sortWithinPartitions("gram")
    matches = ordered.select("context", "gram", "left", "right", "low", "high").mapInArrow(_compare, "context long, before int, after int, low long")
    matches = matches.unionByName(_hot_matches(entries.where("hot").select("context", "left", "right", "low", "high")))
    spans = members.select("doc_id", "at", "context").join(matches, "context")
    size = F.lit(MIN_WORDS)
    spans = spans.select("doc_id", F.greatest(F.col("at") - F.col("before"), F.lit(0)).alias("start"), (F.col("at") + F.col("after")).alias("end"), "low")
    # Contexts that pass a document's ends are cut there.
    lengths = docs.select("doc_id", _n_words().alias("words")).groupBy("doc_id").agg(F.max("words").alias("words"))
    spans = spans.groupBy("doc_id", "start", "end").agg(F.min("low").alias("low")).join(lengths, "doc_id")
    spans = spans.select("doc_id", "start", F.least("end", "words").alias("end"), "low").where(F.col("end") - F.col("start") >= size)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("*", F.when(F.col("start") <= reached, 0).otherwise(1).alias("new"))
    spans = spans.select("*", F.sum("new").over(order).alias("island"))
    spans = spans.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("low").alias("first_doc_id"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def _n_words() -> F.Column:
    blank = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return blank
