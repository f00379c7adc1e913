"""Neighbours where no cell can be left out: what is moved stays in proportion, products miss no row."""

import numpy as np
import pytest

from tidewatch.operators import neighbours
from tidewatch.operators.detectors import LocalOutlierFactor
from tidewatch.operators.neighbours import closest_rows, nearest


def test_visits_are_no_more_than_queries(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(neighbours, "cut", lambda df, name: seen.setdefault(name, df))
    x = np.random.default_rng(1).standard_normal((300, 30))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = nearest(df, df, 4).orderBy("id").collect()
    assert seen["visits"].count() == 300  # nearly 300 times 17 cells before
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert [[e.id for e in r.near] for r in got] == order.tolist()


@pytest.mark.parametrize("kind", ["wide", "far from 0", "repeated", "close clusters"])
def test_products_miss_no_row(monkeypatch, kind):
    monkeypatch.setattr(neighbours, "HELD", 64)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 20))
    if kind == "far from 0":
        x += 1e6
    if kind == "repeated":
        x[::2] = x[0]
    if kind == "close clusters":
        x = x * 1e-5 + 1e3 * rng.standard_normal((5, 20))[rng.integers(0, 5, 1000)]
    q, ids = x[:50], rng.permutation(1000)
    d = np.zeros((50, 1000))
    for c in range(20):
        d += (q[:, c, None] - x[None, :, c]) ** 2
    d = np.sqrt(d)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :7]
    reach = np.take_along_axis(d, order, 1)[:, -1] * 1.5 + 1e-9
    query, far, id = closest_rows(q, reach, x, ids, 7)
    assert query.tolist() == np.repeat(np.arange(50), 7).tolist()
    assert (id.reshape(50, 7) == ids[order]).all() and (far.reshape(50, 7) == np.take_along_axis(d, order, 1)).all()


def test_held_rows_are_measured_exactly():
    x = np.random.default_rng(3).standard_normal((600, 8)) + 1e5
    x[300:] = x[:300]
    d, i = LocalOutlierFactor._near(x, x, 3)
    assert (d[:, :2] == 0).all()  # products left about 1e-3 between equal rows
    assert (i[:, :2] == np.c_[np.arange(600) % 300, np.arange(600) % 300 + 300]).all() and d.shape == (600, 3)
    assert LocalOutlierFactor._near(x[:2], x[:2], 5)[0].shape == (2, 2)
