import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from tidewatch.llm import collocations as module
from tidewatch.llm.collocations import collocations


def brute_force(rows, support=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in candidates.items():
            if not (longer[p] and 100 * longer[p] >= 80 * a):
                score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def check(df, **options):
    want = brute_force([tuple(r) for r in df.select("lang", "text").collect()], **options)
    out = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations(df, **options).collect()]
    assert set(out) == want and len(out) == len(want)
    return want


@pytest.mark.parametrize("chunk", [16_000_000, 20_000])
def test_documents(docs, monkeypatch, chunk):
    monkeypatch.setattr(module, "CHUNK", chunk)
    assert check(docs)
    assert check(docs, support=4, top=50)


def test_edge_cases(edge_docs, spark):
    check(edge_docs.selectExpr("*", "if(doc_id % 4 = 0, null, 'en') as lang"), support=2)
    rows = [("en", "de der en. De der, en\tde der!en  de der en"), ("de", "en der de en der de. en"), (None, "und so und so und so"), ("und", "und so. und so; so und"), ("en", None), ("fr", ""), ("es", "a  b\r\na b\x0ba b?:a b.")] * 3
    assert {r[0] for r in check(spark.createDataFrame(rows, "lang string, text string"), support=3)} == {"en", "de", "und", "es"}


def test_few_bits_lose_nothing(docs, monkeypatch):
    """With a map so small that it keeps nearly every phrase, the result is the same."""
    monkeypatch.setattr(module, "BITS", 1 << 8)
    assert check(docs, support=5)


def test_empty(no_docs):
    out = collocations(no_docs)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.collect() == []


def test_a_task_holds_few_chunks(spark, tmp_path, monkeypatch):
    """Row groups of the chunks' tables are bounded, however many chunks a file has, and tables that are done with are gone."""
    import pyarrow.parquet as pq

    cuts = module.slices
    monkeypatch.setattr(module, "slices", lambda texts, n: cuts(texts, 1000))
    monkeypatch.setattr(module, "CHUNK", 1000)
    real, groups, folders = module.cut_to, [], []

    def seen(df, path, *more, **options):
        out = real(df, path, *more, **options)
        folders.append(path.removeprefix("file:"))
        for f in Path(folders[-1]).glob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            groups.append((meta.num_rows, max([meta.row_group(i).num_rows for i in range(meta.num_row_groups)], default=0)))
        return out

    monkeypatch.setattr(module, "cut_to", seen)
    rows = [("en", f"the red fox ran {i % 7} times over the hill. and then the red fox sat") for i in range(400)]
    check(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert max(n for n, _ in groups) > 10, groups
    assert max(g for _, g in groups) <= module.CHUNKS
    assert len(folders) == 4 and not any(Path(f).exists() for f in folders)
