import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import decontaminate as module
from tidewatch.llm.decontaminate import RADIUS, contaminated, decontaminate, simhash, within_radius


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(w, k):
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def brute_force(docs, items):
    """Best similarity of any window of each pair, over the threshold."""
    out = {}
    for item_id, text in items:
        item = words(text)
        if not item:
            continue
        k = min(5, len(item))
        own = Counter(shingles(item, k))
        for doc_id, text in docs:
            w = words(text)
            for s in range(max(1, len(w) - len(item) + 1)):
                window = Counter(shingles(w[s : s + len(item)], k))
                common = sum((own & window).values())
                everything = sum((own | window).values())
                if common and 100 * common >= 75 * everything:
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), common / everything)
    return out


def found(docs, benchmark):
    return {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, benchmark).collect()}


def test_planted(spark):
    """Exact, edited and cut passages, short items, repeated shingles."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 59)))) for i in range(12)]
    items += [(20, "aaaa bbbb cccc"), (21, "one two " * 10), (22, None), (23, ""), (24, "x")]
    docs = []
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 80))]
        passage = words(items[i % 12][1])
        for _ in range(i % 5):
            at = rng.randrange(len(passage))
            passage[at : at + rng.choice([0, 1, 1])] = rng.choice([[word()], [], [word()]])
        if i % 3:
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() if i % 2 else w for w in passage]
        docs.append((i, " ".join(body), "k", 1))
    docs += [(200, "AAAA bbbb\ncccc dddd", "k", 1), (201, "one two " * 7, "k", 1), (202, None, "k", 1), (203, " ", "k", 1), (204, "x", "k", 1), (204, "x", "k", 1), (205, "so one two one two one two one two one two one two one two one two one two one two", "k", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string, k int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_force([d[:2] for d in docs], items)
    got = found(df, benchmark)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontaminate(df, benchmark)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {k for k, _ in want}


def test_documents(spark, sf_dir):
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, items = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()]
    held = {}
    for k, t in items:
        for s in set(shingles(words(t), 5)):
            held.setdefault(s, set()).add(k)
    near = [(d, t) for d, t in rows if any(s in held for s in shingles(words(t), 5))]
    assert found(docs, benchmark) == brute_force(near, items)


def test_empty(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(edge_docs, none).count() == 0
    assert contaminated(no_docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_simhash(spark):
    rng = random.Random(9)
    rows = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 3, 30, 126, 127, 128, 200)] + [[5, 5, -1], [-1] * 127, [-(2**63)] * 4]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<long>").select("i", simhash(F.col("h")).alias("s")).collect()
    for r in got:
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in rows[r.i]) > len(rows[r.i]))
        assert r.s % 2**64 == want


def test_index_finds_all_within_the_radius(spark):
    """Every fingerprint of the same size within the radius once, and none beyond; the joins by shuffle too."""
    rng = random.Random(2)
    items = [(i, rng.getrandbits(64), i % 3) for i in range(40)]
    windows = []
    for i in range(600):
        key, own, size = rng.choice(items)
        bits = sum(1 << b for b in rng.sample(range(64), rng.choice([0, 5, 15, 22, 23, 24, 30])))
        windows.append((i, own ^ bits, size))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    left = spark.createDataFrame([(i, signed(x), s) for i, x, s in windows], "i int, fingerprint long, size int").repartition(3)
    right = spark.createDataFrame([(k, signed(x), s) for k, x, s in items], "item_key int, item_fingerprint long, size int")
    want = sorted((i, k) for i, x, s in windows for k, y, t in items if s == t and (x ^ y).bit_count() <= RADIUS)
    for small in (True, False):
        assert sorted((r.i, r.item_key) for r in within_radius(left, right, small).collect()) == want


def test_the_index_makes_the_candidates(spark, monkeypatch):
    """An index that finds nothing leaves nothing, whatever shingles are shared."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "a b c d e f g h i j"), (5, "c d e f g h i j k l"), (6, "c d e f g h i j k l m")], "item_id long, text string")
    assert {(r.item_id, r.start, r.similarity) for r in contaminated(docs, items).collect()} == {(5, 0, 1.0), (6, 1, 0.75)}
    monkeypatch.setattr(module, "within_radius", lambda windows, items, small: within_radius(windows, items.where("false"), small))
    assert contaminated(docs, items).count() == 0
