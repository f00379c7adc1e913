import random
import re

from tidewatch.llm.near_dup import near_duplicates


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """component of each id, by comparing all pairs that share a shingle."""
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
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute_force(rows)


def test_documents(docs):
    check(docs)


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_families_without_a_centre(spark):
    """Chains of drifting copies, families at the threshold, copies of one base, short texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for size in (12, 40, 200):
        text = [word() for _ in range(size)]
        for _ in range(25):
            texts.append(list(text))
            text[rng.randrange(size)] = word()
        base = [word() for _ in range(size)]
        for k in range(60):
            copy = list(base)
            for _ in range(1 + k % 4):
                copy[rng.randrange(size)] = word()
            texts.append(copy)
    base = [word() for _ in range(7)]
    texts += [base[:n] for n in range(3, 8)] + [base[:5] + [w] for w in base]
    rng.shuffle(texts)
    check(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4))


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_repeated_rows_and_rows_without_id(spark):
    from corpus_pipeline import near_duplicate
    from tidewatch.llm.near_dup import _across

    a, b = " ".join(f"w{i}" for i in range(104)), " ".join(f"w{i}" if i < 90 else f"v{i}" for i in range(104))
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (None, "some clean text without an id")], "doc_id long, text string")
    state = spark.createDataFrame([(1, 100, 1), (2, 100, 2)], "id long, n long, component long")
    assert {tuple(sorted((r.a, r.b))) for r in _across(state, docs.where("doc_id > 0"), 75).collect()} == {(1, 2)}
    assert sorted(str(r.doc_id) for r in near_duplicate(spark, docs, "").collect()) == ["1", "1", "None"]
