import random
import re

import pytest

from tidewatch.llm import suffix_dedup
from tidewatch.llm.suffix_dedup import repeated_passages


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute_force(rows, size=50):
    """Merged spans of words covered by a window of 50 words that another document holds."""
    held, texts = {}, {}
    for k, t in rows:
        texts[k] = words(t)
        for i in range(len(texts[k]) - size + 1):
            held.setdefault(tuple(texts[k][i : i + size]), set()).add(k)
    out = set()
    for k, w in texts.items():
        spans = []
        for i in range(len(w) - size + 1):
            if len(held[tuple(w[i : i + size])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        out |= {(k, a, b) for a, b in spans}
    return out


def found(df):
    return {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(df).collect()}


def test_planted(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 90, 300, 49)]
    docs = []
    for i in range(150):
        body = [word() for _ in range(rng.randrange(150))]
        for p in rng.sample(passages, i % 4):
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() if i % 2 else w for w in p]
        docs.append((i, rng.choice([" ", "\n"]).join(body), i))
    docs += [(200, docs[5][1], 1), (201, docs[5][1], 1), (202, " ".join(docs[7][1].split()[1:]), 1), (203, None, 1), (204, "", 1)]
    inner = [word() for _ in range(60)]
    docs += [(205, " ".join(inner + [word()] + inner), 1)]  # repeats itself only
    df = spark.createDataFrame(docs, "doc_id long, text string, gram int").repartition(4)
    assert found(df) == brute_force([d[:2] for d in docs])


def test_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute_force(rows)


def test_edges(edge_docs, no_docs):
    assert found(edge_docs) == set()
    assert found(no_docs) == set()


def hidden_matches():
    """(a) A passage that its document repeats hundreds of times; (b) one whose parts many other documents hold."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    passage, own = some(60), []
    for _ in range(300):
        own += passage + some(40)
    docs = [(0, own), (1, some(45) + passage + some(45))]
    left, gram, right = some(17), some(16), some(17)
    docs += [(i, some(60) + left + gram + right + some(60)) for i in (500, 501)]
    docs += [(10 + i, some(60) + (left + gram + some(60) if i % 2 else gram + right + some(60))) for i in range(400)]
    return [(k, " ".join(w)) for k, w in docs]


@pytest.mark.parametrize("hot", [10_000, 5])
def test_no_match_is_hidden(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = hidden_matches()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_force(rows)
    assert len([w for w in want if w[0] == 0]) == 300 and {w[0] for w in want} == {0, 1, 500, 501}
    assert found(df) == want
