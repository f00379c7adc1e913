"""Benchmark decontamination by SimHash of item-sized windows, verified on weighted shingles. Native operations only.

A window of a document is as long as the benchmark item it is held against. A window without any shingle of an item has
similarity 0, and sliding a window to the right until its first shingle is one of the item's loses no common shingle, so
for each size of items the windows that begin at a shingle of any item of that size (moved back where they would pass
the end) hold every best match; only where a window may begin is taken from the shingles, not which item it is like.
Each window gets a 64-bit SimHash of its shingles, which is looked up in a multi-index of the items' fingerprints: 64
bits are cut into RADIUS + 1 blocks, two fingerprints within RADIUS bits agree in at least one block, so a join on (size,
block, value) finds all of them; a pair counts at the first block it agrees in. What lies within the radius is verified
exactly: the weight of a shingle is how often it occurs, the similarity is the sum of smaller weights over that of
larger ones.

At the threshold 0.75 two windows of equal size differ in 11 of 64 bits on average (deviation 3); the radius
of 23 leaves out about 2 pairs in 100,000 that reach it.

Defined results: words are lower-cased (A-Z) runs of anything but ASCII white space; an item of fewer than five
words is one shingle of its length, a document of fewer words than an item is one window; null, empty and white
texts match nothing; rows that repeat a document or item add nothing, different texts of one item_id are each
held against; rows without an id take no part; of windows with equal similarity the first is returned; very long texts
are searched whole. No documents or no items: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import cut

SHINGLE = 5
RADIUS = 23
#: Up to so many item shingles are broadcast (16 MB); beyond that the join shuffles.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; an empty array for null."""
    parts = F.split(F.translate(text, _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+")
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def shingle_hashes(words: Column, k: Column | int) -> Column:
    """Hashes of the k-word shingles; the whole sequence if there are fewer words (none: an empty array)."""
    k = F.lit(k) if isinstance(k, int) else k
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.when(k > j, F.get(words, i + j)) for j in range(SHINGLE)]))


_LANES, _PAIRS = 0x0101010101010101, 0x0001000100010001


def simhash(shingles: Column) -> Column:
    """A bit is set where most of the shingles' hashes have it, counted as often as they occur.

    Up to 127 shingles are counted in eight longs of eight byte-wide lanes; more of them bit by bit.
    """
    def bit(b: Column) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
        return F.when(ones * 2 > F.size(shingles), F.lit(1)).otherwise(F.lit(0)).cast("long")

    zero = F.lit(0).cast("long")
    slow = F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda s, b: s.bitwiseOR(F.call_function("shiftleft", bit(b), b)))
    # Every other lane has room for a carry: added to the bias, a lane's high bit shows whether half of the shingles and one have the bit.
    bias = (F.lit(127) - F.floor(F.size(shingles) / 2)).cast("long") * _PAIRS
    fast = None
    for j in range(8):
        lanes = F.aggregate(shingles, zero, _lane(j))
        even, odd = (F.shiftrightunsigned(F.shiftrightunsigned(lanes, k).bitwiseAND(F.lit(255 * _PAIRS)) + bias, 7).bitwiseAND(F.lit(_PAIRS)) for k in (0, 8))
        ones = F.shiftleft(even.bitwiseOR(F.shiftleft(odd, 8)), j)
        fast = ones if fast is None else fast.bitwiseOR(ones)
    return F.when(F.size(shingles) <= 127, fast).otherwise(slow)


def _lane(shift: int):
    return lambda s, h: s + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_LANES))


_EDGES = [64 * j // (RADIUS + 1) for j in range(RADIUS + 2)]


def _block(fingerprint: Column, j: int) -> Column:
    return F.shiftrightunsigned(fingerprint, _EDGES[j]).bitwiseAND(F.lit((1 << (_EDGES[j + 1] - _EDGES[j])) - 1).cast("long"))


def index_keys(fingerprint: Column, size: Column) -> Column:
    """The keys of a fingerprint in the multi-index: one of (size, block, value) for each block, as an array of longs."""
    return F.array(*[(size.cast("long") * 32 + j) * 16 + _block(fingerprint, j) for j in range(RADIUS + 1)])


def first_block(differ: Column) -> Column:
    """The first block in which two fingerprints agree, given the bits they differ in; null if there is none."""
    return F.coalesce(*[F.when(_block(differ, j) == 0, j) for j in range(RADIUS + 1)])


def within_radius(windows: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """``windows(.., fingerprint, size)`` with the ``item_key`` of each item of ``items(item_key, item_fingerprint, size)``
    of the same size whose fingerprint lies within RADIUS bits."""
    index = items.select(F.explode(index_keys(F.col("item_fingerprint"), F.col("size"))).alias("key"), "item_key", "item_fingerprint")
    looked_up = windows.select("*", F.posexplode(index_keys(F.col("fingerprint"), F.col("size"))).alias("block", "key"))
    found = looked_up.join(F.broadcast(index) if small else index, "key")
    differ = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    return found.where((F.bit_count(differ) <= RADIUS) & (first_block(differ) == F.col("block"))).select(*windows.columns, "item_key")


def common_weight(a: Column, b: Column) -> Column:
    """The sum of the smaller counts of each shingle of two arrays."""
    def counted(x: Column, u: Column) -> Column:
        return F.size(F.filter(x, lambda h: h == u))

    slow = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, u: s + F.least(counted(a, u), counted(b, u)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(slow)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, k, item_words, size, item (shingle hashes), item_fingerprint: one row for each distinct item with words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    # Few rows with much work each: dealt to as many tasks as a shuffle has.
    items = items.distinct().repartition(int(benchmark.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("item_id", "words"))
    items = items.select("item_id", F.xxhash64("item_id", "words").alias("item_key"), "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), F.size("words").alias("item_words"))
    items = items.select("item_key", "item_id", "k", "item_words", (F.col("item_words") * 8 + F.col("k")).alias("size"), shingle_hashes(F.col("words"), F.col("k")).alias("item"))
    return items.select("*", simhash(F.col("item")).alias("item_fingerprint"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, item_id, start (first word of the window), n_words, similarity: each pair's best window over the threshold."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    items = cut(item_shingles(benchmark), "items")
    shingles = {r.k: r.n for r in items.groupBy("k").agg(F.sum(F.size("item")).alias("n")).collect()}  # at most five rows
    small = sum(shingles.values()) <= BROADCAST_ROWS
    held = F.broadcast if small else lambda df: df
    keys = held(items.select("k", "item_words", F.explode("item").alias("shingle")).distinct())
    starts = None
    for k in sorted(shingles) or [SHINGLE]:
        words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
        own = words.select("doc_id", F.size("words").alias("n_words"), F.posexplode(shingle_hashes(F.col("words"), k)).alias("at", "shingle"))
        own = own.join(keys.where(F.col("k") == k), "shingle")
        start = F.least("at", F.greatest(F.col("n_words") - F.col("item_words"), F.lit(0)))
        own = own.select("doc_id", "k", "item_words", start.alias("start"))
        starts = own if starts is None else starts.unionByName(own)
    places = starts.groupBy("doc_id").agg(F.collect_set(F.struct("k", "item_words", "start")).alias("places"))

    found = docs.join(places, "doc_id").select("doc_id", words_of(F.col("text")).alias("words"), "places")
    by_k = F.create_map(*[x for k in sorted(shingles) or [SHINGLE] for x in (F.lit(k), shingle_hashes(F.col("words"), k))])
    found = found.select("doc_id", "places", by_k.alias("shingles"))

    def window(w: Column) -> Column:
        own = F.slice(F.element_at("shingles", w["k"]), w["start"] + 1, F.greatest(w["item_words"] - w["k"] + 1, F.lit(1)))
        return F.struct((w["item_words"] * 8 + w["k"]).alias("size"), w["start"].alias("start"), own.alias("window"))

    windows = found.select("doc_id", F.explode(F.transform("places", window)).alias("w")).select("doc_id", "w.*").withColumn("fingerprint", simhash(F.col("window")))
    near = within_radius(windows, items.select("item_key", "item_fingerprint", "size"), small)
    near = near.join(held(items.select("item_key", "item_id", "item_words", "item")), "item_key")
    common = common_weight(F.col("window"), F.col("item"))
    near = near.select("doc_id", "item_id", "start", "item_words", common.alias("common"), (F.size("window") + F.size("item") - common).alias("all"))
    near = near.where(f"100 * common >= {threshold} * `all`")
    best = F.max(F.struct((F.col("common") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start"), "item_words")).alias("best")
    near = near.groupBy("doc_id", "item_id").agg(best)
    return near.select("doc_id", "item_id", (-F.col("best.start")).alias("start"), F.col("best.item_words").alias("n_words"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: int = 75) -> DataFrame:
    """``docs`` without the documents that hold a window like a benchmark item."""
    bad = contaminated(docs, benchmark, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
