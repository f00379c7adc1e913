import random
import re

import numpy as np
import pytest

from tidewatch.llm import jaccard_join
from tidewatch.llm.jaccard_join import COUNTERS, jaccard_components, ordered_prefix, prefix_length


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_force(rows):
    """n_shingles and component of each id, by all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    for a, b in {(a, b) for v in holders.values() if len(v) > 1 for i, a in enumerate(v) for b in v[i + 1 :]}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: (len(s), root(k)) for k, s in sets.items()}


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute_force(rows)


def test_documents(docs):
    check(docs)


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_empty(no_docs):
    out = jaccard_components(no_docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.collect() == []


@pytest.mark.parametrize("wide", [64, 3])
def test_families(spark, monkeypatch, wide):
    """Drifting chains, copies of one base, texts at the threshold, and texts that share most of a common passage without a link."""
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, common = [], [word() for _ in range(60)]
    for size in (9, 60, 150):
        text = [word() for _ in range(size)]
        for _ in range(20):
            texts.append(list(text))
            text[rng.randrange(size)] = word()
        base = [word() for _ in range(size)]
        for k in range(40):
            copy = list(base)
            for _ in range(k % 3):
                copy[rng.randrange(size)] = word()
            texts.append(copy)
    texts += [common + [word() for _ in range(k % 9)] for k in range(60)]
    texts += [base[:n] for n in range(1, 9)]
    rng.shuffle(texts)
    check(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4))


def test_prefixes_of_linked_sets_meet_in_every_order():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 40, COUNTERS).astype(np.uint8)
    for n in (1, 2, 6, 7, 40, 333):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(n * 0.15 * rng.random())
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(n * 0.1 * rng.random()), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                for order in range(3):
                    x, y = (ordered_prefix(s, classes, order, 85) for s in (a, b))
                    assert len(x) == prefix_length(len(a), 85) and len(np.intersect1d(x, y))


def test_repeated_rows_and_rows_without_id(spark):
    a = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(7, a), (7, a), (9, a), (None, a), (None, "alone and without id here"), (3, None), (9, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_components(docs).collect())
    assert got == [("3", "3"), ("7", "7"), ("7", "7"), ("9", "7"), ("9", "9"), ("None", "7"), ("None", "None")]


def test_near_copies_meet_once_not_for_each_shared_shingle(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "WIDE", 3)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    made, across = [], jaccard_join._across

    def counted(*args):
        out = across(*args)
        made.append((out.count(), out.selectExpr("least(a, b)", "greatest(a, b)").distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "_across", counted)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    (rows, pairs), = made
    assert pairs and rows <= 3 * pairs


def test_signatures_keep_linked_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 5, 97, 400, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for changed in {0, 1, n // 20, n // 8}:
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)]))
            bits = int(np.unpackbits((jaccard_join.signature(a) ^ jaccard_join.signature(b)).view(np.uint8)).sum())
            assert bits <= len(np.setxor1d(a, b))


def test_near_misses_of_a_group_are_not_joined(spark, monkeypatch):
    """Copies that share their first shingles and yet don't link: what the group's size squares to is never made."""
    monkeypatch.setattr(jaccard_join, "WIDE", 3)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    made, across = [], jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda *args: made.append((out := across(*args)).count()) or out)
    rng = random.Random(7)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for i in range(40):
        copy = list(base)
        copy[2], copy[6 + 2 * i] = f"x{i}", f"y{i}"
        texts.append(" ".join(copy))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert made[0] <= len(texts)
