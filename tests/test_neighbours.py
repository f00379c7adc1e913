"""Exact neighbours by cells: against all pairs, with repeated rows, few rows, hot cells; the outlier factor in both forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors, neighbours
from tidewatch.operators.detectors import LocalOutlierFactor
from tidewatch.operators.neighbours import nearest
from tidewatch.sources import io


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def plain(q, x, k):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, order, 1), order


@pytest.mark.parametrize("kind", ["clusters", "repeated", "few"])
def test_neighbours_by_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 15)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3)) + 20 * rng.integers(0, 4, (300, 1))
    if kind == "repeated":  # a third of the rows are one point
        x[::3] = x[0]
    if kind == "few":
        x = x[:4]
    q = np.concatenate([x[:60], rng.standard_normal((20, 3)) * 30])
    got = nearest(frame(spark, q), frame(spark, x), 6).orderBy("id").collect()
    d, order = plain(q, x, 6)
    assert len(got) == len(q)
    for r, a, b in zip(got, d, order, strict=True):
        assert [e.d for e in r.near] == pytest.approx(a.tolist(), abs=1e-9)
        if kind != "repeated":  # sums in another order may tell apart what is one distance
            assert [e.id for e in r.near] == b.tolist()
    assert nearest(frame(spark, q[:2]), frame(spark, x).limit(0), 3).count() == 0


def test_cells_are_left_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(neighbours, "cut", lambda df, name: seen.append((name, df)) or df)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2)) + 100 * rng.integers(0, 8, (400, 1))
    nearest(frame(spark, x), frame(spark, x), 5)
    visits = dict(seen)["visits"]
    cells = dict(seen)["cells"].select("cell").distinct().count()
    assert visits.count() < 0.5 * 400 * cells


def test_both_forms_of_the_outlier_factor_agree(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame(rng.standard_normal((250, 2)), columns=["a", "b"]).assign(id=range(250))
    rows.loc[:4, ["a", "b"]] = 9 + rng.standard_normal((5, 2))
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame([(None, 1.0, 250), (float("nan"), 1.0, 251)], "a double, b double, id long"))
    held = LocalOutlierFactor(("a", "b"), n_neighbors=10).fit(df)
    monkeypatch.setattr(detectors, "LARGEST", 10)
    table = LocalOutlierFactor(("a", "b"), n_neighbors=10).fit(df)
    assert "table" in table.fitted and table.fitted["limit"] == pytest.approx(held.fitted["limit"])
    a, b = (m.transform(df).orderBy("id").toPandas() for m in (held, table))
    assert np.allclose(a["score"], b["score"], equal_nan=True) and (a["flag"] == b["flag"]).all() and len(b) == 252
    assert b["score"][250:].isna().all() and b["flag"][:5].sum() >= 4
    assert set(table.transform(df).columns) == set(held.transform(df).columns)
    assert table.transform(df.where(F.lit(False))).count() == 0
    io.save_model(table, str(tmp_path / "lof"))
    again = io.load_model(str(tmp_path / "lof"))
    assert again.fitted["table"].startswith(str(tmp_path))
    assert np.allclose(again.transform(df).orderBy("id").toPandas()["score"], b["score"], equal_nan=True)
    io.save_model(again, str(tmp_path / "lof"))  # where it lies already
    assert spark.read.parquet(again.fitted["table"]).count() == 250
