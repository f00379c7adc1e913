import re

import corpus_pipeline
from tests.llm.test_decontaminate import shingles, words
from tests.llm.test_near_dup import brute_force as components
from tests.llm.test_pii import brute_force as spans


def test_stages(spark, sf_dir):
    """Each stage on its own input, against brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and after.keys() <= before.keys()
        if name == "near_duplicate":
            kept = components([(k, r.text) for k, r in before.items()])
            assert after.keys() == {k for k, v in kept.items() if v[2]}
        if name == "decontamination":
            items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            every = [set(shingles(w, 5)) for w in items]
            for k in before.keys() - after.keys():
                own = set(shingles(words(before[k].text), 5))
                assert any(len(own & s) >= 0.7 * len(s) for s in every)
            for r in after.values():
                own = " " + " ".join(words(r.text)) + " "
                assert not any(f" {' '.join(w)} " in own for w in items)
        if name == "sanitisation":
            assert after.keys() == before.keys()
            assert not any(s for r in after.values() for s in spans(re.sub(r"\[[A-Z]+\]", "", r.text)) if s.startswith("email"))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name != "toxicity":
            assert all(after[k].text == before[k].text for k in after)
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == len(before)


def test_empty(spark, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
