"""N-gram Jaccard join by several global orders of the shingles, confirmed on full sets.

Under any order of all shingles, a pair over the threshold shares one of the first n - ceil(t n) + 1 shingles (the
prefix) of both texts. A pair is a candidate only if that holds under three orders at once. All orders begin with rare
shingles: a shingle's class is the logarithm of a counter that it shares with few others (``COUNTERS`` in all,
filled from every text), and within a class each order has its own permutation. The first order is an index by
shingle; the prefixes of the two others are intersected for each candidate, in wide buckets as part of the join's key.

Texts of one shingle set are one node, so copies cost nothing. A bucket of the index does not list its pairs: a node
meets the leader that it shares most buckets with, up to three times (from the second on the one with most links; a round that links few of its
candidates is the last); components are found; then rows of different
components that still share a bucket meet each other. So no link between components is lost, and a group of near copies never costs
its square. Where a bucket is wide, rows meet only if they share a shingle of the second order's prefix as well, and a pair comes up
at the first shingles that it shares, not at all of them. A text has a signature, the parity of its shingles by 512
classes of their hashes: linked sets differ in few shingles, so in few bits, and near misses are left out where rows meet. Texts
that share no bucket are told by bits of a fixed size before the one shuffle of texts.

Defined results: words are lower-cased (A-Z) runs of anything but ASCII white space; a text of fewer than four words has its
whole sequence as its one shingle; null, empty and white texts have no shingle and no link. Rows that repeat a doc_id
are each judged by their own text; a row without one belongs to the texts of its very shingle set alone (component_id
is null if none of them has an id). Texts are read whole, whatever their length. Ties in an order don't matter, as every order is total.
Further columns are not read. An empty table gives an empty one. doc_id must be an integer, or text of one. Sets and shingles are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.words import mix, shingle_hashes, slices, word_hashes
from tidewatch.operators.components import connected_components
from tidewatch.sources.scratch import bucketed_table, cut, drop_table

SHINGLE = 4
THRESHOLD = 85
#: Counters of the shingles' frequency, in so many blocks; one megabyte of classes is what tasks get.
COUNTERS, BLOCKS = 1 << 20, 256
#: Buckets of more rows than this are joined by shingles of two orders.
WIDE = 64
#: Tokens of counters over this are dealt to so many tasks.
HOT, SALT = 20_000, 64
#: Rounds with one leader a bucket and one pair a node; one that links under a share of 1 / FEW of its candidates is the last.
ROUNDS, FEW = 3, 20
#: Words of 64 bits in a text's signature.
SIGNATURE = 8
#: A bit for each so many hashes tells which texts share a bucket at all: 8 MB, whatever the corpus.
BITS = 1 << 26
#: So many of a text's first shingles in an order tell at which of them a pair has come up already.
EARLIER = 8

_PERMUTED = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(texts)
    h, offsets = shingle_hashes(words, first, k)
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def prefix_length(n: int, threshold: int) -> int:
    """n - ceil(t n) + 1."""
    return n - (threshold * n + 99) // 100 + 1


def set_key(own: np.ndarray) -> np.uint64:
    return mix(np.add.reduce(mix(own), keepdims=True) + np.uint64(len(own)))[0]


def signature(own: np.ndarray) -> np.ndarray:
    """Whether each class of shingles has an odd number in the set: two sets differ in at least as many shingles as signatures in bits."""
    odd = np.bincount((mix(own ^ _PERMUTED[0]) % np.uint64(64 * SIGNATURE)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _block_bits(t: pa.Table) -> pa.Table:
    """One block of the bits of ``node_bits``."""
    own = np.asarray(t.column("node")).view(np.uint64) % np.uint64(BITS // BLOCKS)
    bits = np.zeros(BITS // BLOCKS, np.uint8)
    bits[own.astype(np.int64)] = 1
    return pa.table({"block": t.column("block")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def node_bits(nodes: DataFrame) -> np.ndarray:
    """A bit, of ``BITS``, is set where some node's hash falls. Which texts can't be wanted, without a join that moves all of them."""
    block = F.pmod(F.shiftright("node", (BITS // BLOCKS).bit_length() - 1), F.lit(BLOCKS)).cast("int").alias("block")
    out = np.zeros((BLOCKS, BITS // BLOCKS // 8), np.uint8)
    for r in nodes.select(block, "node").groupBy("block").applyInArrow(_block_bits, "block int, bits binary").collect():  # BLOCKS rows
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _set_bits(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = nodes % np.uint64(BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _features(k: int):
    """One row a text (doc_id, n, node), and at a task's end its counters in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for texts in slices(batch.column("text")):
                own, ids = ids.slice(0, len(texts)), ids.slice(len(texts))
                sets = shingle_sets(texts, k)
                if any(map(len, sets)):
                    counters += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                node = np.fromiter((set_key(s) for s in sets), np.uint64, len(sets))
                none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(node.view(np.int64)), *none], ["doc_id", "n", "node", "block", "counts"])
        if counters.any():
            none = [pa.nulls(BLOCKS, pa.int64())] * 3
            blocks = [x.tobytes() for x in counters.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], ["doc_id", "n", "node", "block", "counts"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts").combine_chunks())
    return pa.table({"block": t.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _class(count):
    return np.round(4 * np.log2(np.asarray(count) + 1)).astype(np.uint8)


def shingle_classes(features: DataFrame) -> np.ndarray:
    """The class of each counter. The counters of all tasks are added in two steps, so that no group has a row for every task."""
    rows = features.where("block is not null").select("block", "counts", F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("int").alias("salt"))
    rows = rows.groupBy("block", "salt").applyInArrow(_added, "block int, counts binary").groupBy("block").applyInArrow(_added, "block int, counts binary")
    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for r in rows.collect():  # BLOCKS rows
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return _class(out.reshape(-1))


def ordered_prefix(own: np.ndarray, classes: np.ndarray, order: int, threshold: int) -> np.ndarray:
    """The first shingles of a set under an order, in that order; none of an empty set."""
    if not len(own):
        return own
    rank = classes[(own & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mix(own * _PERMUTED[order]) >> np.uint64(8)
    size = prefix_length(len(own), threshold)
    first = np.argpartition(rank, size - 1)[:size]
    return own[first[np.argsort(rank[first], kind="stable")]]


def _index(classes, k: int, threshold: int):
    """token, salt, node, n, at: the first order's prefix of each text; equal sets of a task are listed once.

    A token whose counter is over ``HOT`` is dealt to several tasks by its salt; all others have at most so many rows.
    """
    hot = _class(HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for texts in slices(batch.column("text")):
                token, node, n, at = [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int32)]
                for own in shingle_sets(texts, k):
                    if not len(own) or (key := int(set_key(own))) in seen:
                        continue
                    seen.add(key)
                    first = ordered_prefix(own, classes.value, 0, threshold)
                    token.append(first)
                    at.append(np.arange(1, len(first) + 1, dtype=np.int32))
                    node.append(key)
                    n.append(len(own))
                size = [len(x) for x in at[1:]]
                tokens, nodes = np.concatenate(token), np.repeat(np.array(node, np.uint64), size)
                often = classes.value[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)] >= hot
                salt = np.where(often, (nodes % np.uint64(SALT)).astype(np.int32) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(salt), pa.array(nodes.view(np.int64)), pa.array(np.repeat(np.array(n, np.int32), size)), pa.array(np.concatenate(at))], ["token", "salt", "node", "n", "at"])

    return run


def _shared(index: DataFrame, threshold: int) -> DataFrame:
    """The rows of buckets that may hold a pair: two nodes, one of which has the token early enough for a partner of its size or more.

    One shuffle: a bucket's rows meet in one task, unless its token is hot; those stay.
    """
    index = index.withColumn("early", F.expr(f"{2 * threshold} * n <= {100 + threshold} * (n - at + 1)"))
    w = Window.partitionBy("token", "salt")
    rows = index.select("*", F.min("node").over(w).alias("low"), F.max("node").over(w).alias("high"), F.max("early").over(w).alias("any"))
    rows = rows.where("salt > 0 OR (low < high AND any)").dropDuplicates(["token", "salt", "node"])
    return rows.select("token", "node", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"))


def _prefixes(classes, bits, k: int, threshold: int):
    """node, n, text, second, third, signature of the texts that may be wanted: the other orders' prefixes, by the upper halves of the hashes (a necessary
    condition). Equal sets of a task are listed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for texts in slices(batch.column("text")):
                sets = shingle_sets(texts, k)
                node = np.fromiter((set_key(s) for s in sets), np.uint64, len(sets))
                rows = []
                for i in np.flatnonzero(_set_bits(bits.value, node)).tolist():
                    if len(sets[i]) and (key := int(node[i])) not in seen:
                        seen.add(key)
                        rows.append(i)
                more = [[(ordered_prefix(sets[i], classes.value, o, threshold) >> np.uint64(32)).astype(np.uint32).view(np.int32) for i in rows] for o in (1, 2)]
                n, signatures = pa.array([len(sets[i]) for i in rows], pa.int64()), pa.array([signature(sets[i]) for i in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(node[rows].view(np.int64)), n, texts.take(pa.array(rows, pa.int64())), *[pa.array(x, pa.list_(pa.int32())) for x in more], signatures], ["node", "n", "text", "second", "third", "signature"])

    return run


def _linked(k: int, threshold: int):
    """Keeps the pairs of texts whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[s for texts in slices(batch.column(c)) for s in shingle_sets(texts, k)] for c in ("text_a", "text_b")]
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(*sides, strict=True)):
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * common >= threshold * (len(a) + len(b) - common) > 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _may_link(threshold: int, at: str = "at") -> Column:
    """Sizes, and (for the first shared shingle of a pair in an order) what is left behind it, allow the threshold."""
    sizes = F.expr(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    return sizes & F.expr(f"{threshold} * (n_a + n_b) <= {100 + threshold} * (least(n_a - {at}_a, n_b - {at}_b) + 1)")


def _alike(threshold: int) -> Column:
    """Signatures differ in no more bits than linked sets of these sizes may in shingles."""
    bits = sum((F.bit_count(F.col("signature_a")[i].bitwiseXOR(F.col("signature_b")[i])) for i in range(SIGNATURE)), F.lit(0))
    return bits * (100 + threshold) <= (F.col("n_a") + F.col("n_b")) * (100 - threshold)


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    features = cut(docs.mapInArrow(_features(k), "doc_id long, n long, node long, block int, counts binary"), "features")
    classes = spark.sparkContext.broadcast(shingle_classes(features))
    features = features.where("block is null").select("doc_id", "n", "node")
    index = docs.select("text").mapInArrow(_index(classes, k, threshold), "token long, salt int, node long, n int, at int")
    shared = cut(_shared(index, threshold), "shared")
    # No join by doc_id: that would move all texts, of which a part is wanted.
    bits = spark.sparkContext.broadcast(node_bits(shared.select("node").distinct()))
    texts = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(classes, bits, k, threshold), "node long, n long, text string, second array<int>, third array<int>, signature array<long>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, table, folder = bucketed_table(texts.repartition(parts, "node").dropDuplicates(["node"]), ["node"], "prefixes", parts, dealt=True)

    def verified(pairs: DataFrame) -> tuple[DataFrame, bool]:
        """Links, and whether they are few of the candidates."""
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        for side in ("a", "b"):
            own = texts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "second", "third", "signature")])
            pairs = pairs.join(own, side)
        pairs = cut(pairs.where(_alike(threshold)).where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b"), "candidates")
        n = pairs.count()
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
        found = cut(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_linked(k, threshold), "a long, b long"), "links")
        return found, FEW * found.count() < n

    links, labels, few = None, None, ROUNDS == 0
    rows = shared.select("*", F.col("node").alias("component"), F.lit(0).cast("long").alias("degree"))
    for turn in range(ROUNDS + 1):
        last = few or turn == ROUNDS
        if not last:
            lead = rows.groupBy("token").agg(F.max(F.struct("degree", "node", "n", "at", "component")).alias("lead"))
            pairs = rows.join(lead, "token").where("component <> lead.component").selectExpr("node a", "lead.node b", "n n_a", "lead.n n_b", "at at_a", "lead.at at_b")
            pairs = pairs.where(_may_link(threshold)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
            pairs = pairs.groupBy("a").agg(F.max(F.struct("common", "b")).alias("best")).select("a", "best.b")
        else:
            pairs = _across(rows, texts, threshold)
        found, few = verified(pairs)
        links = found if links is None else links.unionByName(found)
        if labels is None or not found.isEmpty():
            labels = connected_components(links)
        if last:
            break
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        known = labels.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node", "full")
        rows = shared.join(known, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
        split = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        rows = cut(rows.join(split, "token", "left_semi"), "open")
        shared = rows.drop("component", "degree")
        if rows.isEmpty():
            break
    drop_table(spark, table, folder)
    known = features.where("n > 0").join(labels, "node", "left").select("doc_id", "n", "node", F.coalesce("component", "node").alias("component"))
    names = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = known.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(features.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _across(rows: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs of open rows of two components. In wide buckets they must share a shingle of the second order's prefix, too.

    There near copies share most of both prefixes, and would meet once for each shingle of the one and each of the other. So a row
    knows the ``EARLIER`` first held shingles that come before its own in either order, and two rows meet only if none of them is shared; the
    first that a pair shares in each order always stay.
    """
    own = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("own"))
    most = own.groupBy("token").agg(F.sum("own").alias("holders"), F.max(F.struct("own", "component")).getField("component").alias("common"))
    rows = cut(rows.join(most, "token").select("token", "node", "n", "at", "component", "common", "holders"), "across")
    narrow, wide = (rows.where(F.col("holders") <= WIDE), ["token"]), rows.where(F.col("holders") > WIDE)
    first = wide.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "token"))), 1, EARLIER).alias("first"))
    before = F.transform(F.filter("first", lambda x: x["at"] < F.col("at")), lambda x: x["token"]).alias("before")
    wide = cut(wide.join(first, "node").select("token", "node", "n", "at", "component", "common", before), "wide")
    second = wide.select("node").distinct().join(texts.select("node", "second"), "node").select("node", F.posexplode("second").alias("at_2", "other"))
    held = second.groupBy("other").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("other")
    second = cut(second.join(held, "other", "left_semi").withColumn("at_2", F.col("at_2").cast("long") + 1), "second")
    begun = second.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("at_2", "other"))), 1, EARLIER).alias("begun"))
    before = F.transform(F.filter("begun", lambda x: x["at_2"] < F.col("at_2")), lambda x: x["other"]).alias("before_2")
    wide = wide.join(second.join(begun, "node").select("node", "at_2", "other", before), "node").join(texts.select("node", "signature"), "node")
    pairs = []
    for part, keys in (narrow, (wide, ["token", "other"])):
        carried = [c for c in ("at", "at_2", "signature", "before", "before_2") if c in part.columns]
        left = part.where("component <> common").selectExpr(*keys, "node a", "n n_a", "component c_a", *[f"{c} {c}_a" for c in carried])
        right = part.selectExpr(*keys, "node b", "n n_b", "component c_b", *[f"{c} {c}_b" for c in carried])
        found = left.join(right, keys).where(F.expr("c_a <> c_b"))
        for c in carried:
            if c.startswith("at"):  # the first shared shingle in either order
                found = found.where(_may_link(threshold, c))
            elif c == "signature":
                found = found.where(_alike(threshold))
            else:
                found = found.where(~F.arrays_overlap(f"{c}_a", f"{c}_b"))
        pairs.append(found.select("a", "b"))
    return pairs[0].unionByName(pairs[1])
