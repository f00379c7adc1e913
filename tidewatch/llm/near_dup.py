"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes keeps both its minimum and its maximum, so 80 permutations give
160 signature values; four values (two permutations) make a band, 40 bands a document. A pair with
Jaccard similarity 0.75 misses all bands with a chance of (1 - 0.75**4)**40, below 3 in 10 million.

Documents with equal shingle sets become one class first. Within a band's bucket no pairs are listed:
every class is compared with the bucket's leader. While a bucket still holds several components, a new
leader (the class with most links so far) is tried. What is left after that is compared pair by pair, but only
across components and only where texts share one of their rarer shingles as any linked pair does (a prefix
filter), so no link is lost and a group of copies never costs its square.

Defined results: words are lower-cased (A-Z) runs of anything but ASCII white space; a document of fewer
than five words has its whole sequence as its one shingle; null, empty and white texts have no shingle and
no link; rows that repeat a ``doc_id`` count as one document. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.words import mix, shingle_hashes, slices, word_hashes
from tidewatch.operators.components import connected_components
from tidewatch.sources.scratch import cut

SHINGLE = 5
PERMUTATIONS = 80
#: Permutations in a band; each gives two values.
BAND = 2
#: Rounds with one leader a bucket before the rest is compared across components.
ROUNDS = 2

_FEATURES = "doc_id long, n long, key_a long, key_b long, bands array<long>"


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and their offsets."""
    words, first = word_hashes(texts)
    h, offsets = shingle_hashes(words, first, SHINGLE)
    sets = [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else h), np.concatenate([[0], np.cumsum(size)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    multipliers, bands = _multipliers(PERMUTATIONS), PERMUTATIONS // BAND
    for batch in batches:
        ids = batch.column("doc_id")
        for texts in slices(batch.column("text")):
            own, ids = ids.slice(0, len(texts)), ids.slice(len(texts))
            h, offsets = shingle_sets(texts)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            at = offsets[:-1][full]
            key = np.zeros((2, len(n)), np.uint64)
            band = np.zeros((len(full), bands), np.uint64)
            if len(full):
                key[0, full] = np.add.reduceat(mix(h), at)
                key[1, full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                for p, m in enumerate(multipliers):
                    x = h * m
                    b = p // BAND
                    band[:, b] = mix(band[:, b] + np.minimum.reduceat(x, at))
                    band[:, b] = mix(band[:, b] + np.maximum.reduceat(x, at))
                band = mix(band + np.arange(1, bands + 1, dtype=np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), lists], ["doc_id", "n", "key_a", "key_b", "bands"])


def _linked(threshold: int):
    """Keeps the pairs of texts whose shingle sets reach the threshold (in hundredths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sets = []
            for side in ("text_a", "text_b"):
                own = []
                for texts in slices(batch.column(side)):
                    h, offsets = shingle_sets(texts)
                    own += [h[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                sets.append(own)
            for i, (a, b) in enumerate(zip(*sets, strict=True)):
                common = len(a) + len(b) - len(np.union1d(a, b))
                keep[i] = 100 * common >= threshold * (len(a) + len(b) - common) > 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        for texts in slices(batch.column("text")):
            own, ids = ids[: len(texts)], ids[len(texts) :]
            h, offsets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, np.diff(offsets))), pa.array(h.view(np.int64))], ["id", "shingle"])


def _across(state: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs of open texts of two components that may be linked: a, b, n_a, n_b.

    The prefix filter of exact set-similarity joins: with the shingles of each text ordered from the rarest on,
    a pair over the threshold shares t or more of its n_a and n_b shingles, so it shares one among the first
    n_a - t + 1 of one text and the first n_b - t + 1 of the other. What a copy has changed is rare and comes first, so
    copies of one text don't meet for what they all have. One side of a pair lies outside the component that
    most holders of a shingle belong to.
    """
    ids = state.select(F.col("id").alias("doc_id"), "n", "component").distinct()
    same, one = Window.partitionBy("shingle"), Window.partitionBy("id").orderBy("holders", "shingle")
    rows = texts.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(_shingles, "id long, shingle long")
    rows = rows.repartition("shingle").dropDuplicates(["id", "shingle"])  # rows that repeat a doc_id are one text
    rows = rows.select("*", F.count(F.lit(1)).over(same).alias("holders")).withColumn("at", F.row_number().over(one))
    rows = rows.join(ids.withColumnRenamed("doc_id", "id"), "id").where(f"holders > 1 and 100 * (at - 1) <= {100 - threshold} * n")
    own = Window.partitionBy("shingle", "component")
    rows = rows.select("shingle", "id", "n", "at", "component", F.count(F.lit(1)).over(own).alias("own"))
    common = F.max(F.struct("own", "component")).over(same)
    rows = cut(rows.select("*", common.getField("component").alias("common")), "across")
    left = rows.where("component <> common").selectExpr("shingle", "id a", "n n_a", "at at_a", "component c_a")
    right = rows.selectExpr("shingle", "id b", "n n_b", "at at_b", "component c_b")
    # (100 + threshold) * t = threshold * (n_a + n_b), rounded up
    least = f"{threshold} * (n_a + n_b) <= {100 + threshold} * (least(n_a - at_a, n_b - at_b) + 1)"
    return left.join(right, "shingle").where(f"c_a <> c_b and {least}").select("a", "b", "n_a", "n_b")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    features = cut(docs.mapInArrow(_features, _FEATURES), "minmax")
    keys = ["key_a", "key_b", "n"]
    classes = features.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    reps = features.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    bucket = Window.partitionBy("bucket")
    buckets = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), "n")
    buckets = buckets.select("*", F.min("id").over(bucket).alias("low"), F.max("id").over(bucket).alias("high"))
    buckets = cut(buckets.where("low < high").select("bucket", "id", "n"), "buckets")
    texts = cut(docs.join(buckets.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        long_enough = f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)"
        pairs = pairs.where(long_enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        pairs = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        pairs = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return cut(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_linked(threshold), "a long, b long"), "verified")

    state = buckets.select("*", F.col("id").alias("component"), F.lit(0).cast("long").alias("degree"))
    links = labels = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            best = F.max(F.struct("degree", (-F.col("id")).alias("key"), "id", "n", "component")).over(bucket)
            pairs = state.select("id", "n", "component", best.alias("lead")).where("component <> lead.component")
            pairs = pairs.selectExpr("id a", "lead.id b", "n n_a", "lead.n n_b")
        else:
            pairs = _across(state, texts, threshold)
        found = verified(pairs)
        links = found if links is None else links.unionByName(found)
        if turn < ROUNDS or not found.isEmpty():
            labels = connected_components(links)
        if turn < ROUNDS:
            ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
            known = labels.withColumnRenamed("node", "id").join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id", "full")
            known = buckets.join(known, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
            known = known.select("*", (F.min("component").over(bucket) < F.max("component").over(bucket)).alias("open"))
            state = cut(known.where("open").drop("open"), "state")
            if state.isEmpty():
                break
    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "doc_id")
    return features.join(classes, keys, "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
