"""Rows go down each tree of a forest as often as it is deep, in blocks; node by node gives the same."""

import numpy as np
import pytest

from tidewatch.operators import detectors


def test_paths_node_by_node(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.integers(0, 4, 300), rng.standard_normal(300), strict=True)], "a double, b double")
    model = detectors.IsolationForest(("a", "b"), n_estimators=12).fit(df)
    x = np.array([(r.a, r.b) for r in df.collect()] + [(9.0, -9.0)])

    def depth(tree, row):
        at = 0
        while tree[at][0] >= 0:
            at = int(tree[at][2] if row[int(tree[at][0])] < tree[at][1] else tree[at][3])
        return tree[at][4]

    trees = model.fitted["trees"]
    want = [2.0 ** (-sum(depth(t, r) for t in trees) / len(trees) / float(detectors._path(model.fitted["size"]))) for r in x]
    monkeypatch.setattr(detectors, "_ROWS", 64)
    assert model._raw()(x) == pytest.approx(want, rel=1e-12)
    assert len(model._raw()(x[:0])) == 0
    leaf = detectors._flat(np.array([[-1, 0, 0, 0, 2.5]]))
    assert leaf[-1] == 0 and leaf[3].tolist() == [2.5]
    assert max(detectors._flat(np.array(t))[-1] for t in trees) <= 9
