import random
import re
import zlib
from collections import Counter

from tidewatch.llm.spelling import first_trie, spelling_forms, trie_paths

LETTERS = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]


def counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def brute_force(rows):
    """All rows, by trying every edit of every word."""
    n = counts(rows)
    out = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for d in (0, 1) for c in LETTERS}
        near = (edits & set(n)) - {w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, None, n[w], len(near), n[form] if form else None]
    for w, r in out.items():
        end = w
        while out[end][0]:
            end = out[end][0]
        r[1] = end
    return {w: tuple(r) for w, r in out.items()}


def check(df):
    got = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute_force(got)
    out = spelling_forms(df).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == want and len(out) == len(want)
    return want


def test_documents(docs):
    assert any(r[0] for r in check(docs).values())


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_empty(no_docs):
    assert spelling_forms(no_docs).collect() == []


def test_chains_ties_and_runs_of_letters(spark):
    """Forms of forms, ties of counts, equal letters side by side, accents, a null id, a word of thousands of letters."""
    rng = random.Random(8)
    texts = ["variants " * 3000, "variantz " * 100, "variantzz " * 10, "varianttzz " * 2, "aaaaaaa " * 50 + "aaaaaaaa " * 5 + "aaaaaaaaa " * 3, "baaaaaa " * 50, "énigmeux " * 40 + "enigmeux " * 4 + "énigmeu " * 4 + "ÉNIGMEUX " * 3, ("x" * 5000 + " ") * 3 + ("x" * 4999 + " ") * 40]
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(7 + rng.randrange(3)))
        texts.append(f"{w} " * (2 + rng.randrange(60)))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (500, None)]
    want = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert want["variantzz"][:2] == ("variantz", "variants")


def test_trie_numbers():
    """The same number for the same beginning and no other, also over the ends of ranges."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    ranges = [words[:100], words[100:101], words[101:250], words[250:]]
    trie = first_trie([r[0] for r in ranges])
    number = {}
    for k, own in enumerate(ranges):
        nodes, sizes = trie_paths(own, trie, (k + 1) << 40)
        for w, size in zip(own, sizes, strict=True):
            path, nodes = nodes[:size], nodes[size:]
            assert size == len(w) + 1
            for i, x in enumerate(path):
                assert number.setdefault(w[:i], x) == x
    assert len(set(number.values())) == len(number)
