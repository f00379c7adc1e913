import zlib

import numpy as np
import pyarrow as pa

from tidewatch.llm.toxicity import WordScores, fit_toxicity, score_toxicity, toxicity_digest, train

CLEAN = ["the ship sails over the calm sea today", "a market sells bread and olive oil", "we walked along the river bank", "people read books in winter"]
BAD = ["zorgling", "frabtious", "mukwump", "dratface"]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    pool = sorted({w for s in CLEAN for w in s.split()} | {"".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)})
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(pool, 40))
        if i % 4 == 0:
            for _ in range(2):
                words.insert(int(rng.integers(40)), str(rng.choice(BAD)))
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 4 == 0))
    return texts, labels


def probabilities(model, texts):
    return model.probability(*WordScores(model).strongest(pa.array(texts, pa.string())))


def test_held_out_accuracy_and_gaps():
    texts, labels = corpus(400, 1)
    model = train(texts, labels)
    other, truth = corpus(400, 2)
    p = probabilities(model, other)
    assert ((p >= 0.3) == np.array(truth)).mean() >= 0.99
    scores = WordScores(model)
    clean = scores._score(["market", "winter", "people"])
    for word in BAD:
        gapped = scores._score([word, word[:3] + "x" + word[3:], ".".join(word)])
        assert gapped.min() > clean.max()
    spelled = probabilities(model, ["we walked " + " ".join(BAD[0]) + " and " + " ".join(BAD[2]) + " along", "we walked a b along"])
    assert spelled[0] > 0.3 > spelled[1]


def test_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity_digest(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = [truth[r.doc_id] == r.predicted for r in held if r.doc_id in truth]
    assert np.mean(right) >= 0.95


def test_edges(spark, edge_docs, no_docs):
    texts, labels = corpus(100, 3)
    model = train(texts, labels)
    rows = {r.doc_id: r for r in score_toxicity(edge_docs, model).collect()}
    assert len(rows) == edge_docs.count() and rows[0].part == 0
    assert rows[0].toxicity == rows[1].toxicity == rows[2].toxicity < 0.3
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity_digest(no_docs, empty).count() == 0
    blank = fit_toxicity(edge_docs, empty)
    assert all(r.toxicity < 0.3 for r in score_toxicity(edge_docs, blank).collect())
