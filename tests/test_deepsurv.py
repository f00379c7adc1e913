"""The neural Cox model: gradient, plain likelihood, a hazard that no line can follow, and curves over many times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import survival
from tidewatch.operators.recurrent import dense, dense_weights
from tidewatch.operators.survival import CoxModel, DeepSurv, concordance, partial_likelihood


def test_gradient_and_likelihood():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((30, 2)), np.column_stack([rng.integers(1, 9, 30), rng.integers(0, 2, 30)]).astype(float)
    w = dense_weights(rng, [2, 5, 1])
    loss, grads = partial_likelihood(w, x, y)
    eta = dense(w, x)[0][:, 0]
    want = -sum(eta[i] - np.log(np.exp(eta[y[:, 0] >= y[i, 0]]).sum()) for i in range(30) if y[i, 1]) / y[:, 1].sum()
    assert loss == pytest.approx(want)
    for k, a in w.items():
        for i in np.ndindex(a.shape):
            kept = a[i]
            a[i] = kept + 1e-6
            high = partial_likelihood(w, x, y)[0]
            a[i] = kept - 1e-6
            low = partial_likelihood(w, x, y)[0]
            a[i] = kept
            assert grads[k][i] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_a_hazard_that_is_not_linear(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (1500, 2))
    t = rng.exponential(1 / np.exp(1.5 * x[:, 0] ** 2 - 2))
    stop = rng.exponential(5, 1500)
    df = spark.createDataFrame([(i, *map(float, a), float(min(u, s)), int(u <= s)) for i, (a, u, s) in enumerate(zip(x, t, stop, strict=True))], "id long, a double, b double, duration double, event int")
    index = lambda m: concordance(m.fit(df.where("id < 1000")).risk(df.where("id >= 1000"))).first().concordance_index
    model = DeepSurv(["a", "b"])
    assert index(model) > max(0.7, index(CoxModel(["a", "b"])) + 0.1)
    curve = model.curve(df.where("id < 3"), "id", [0.1, 1.0, 5.0]).orderBy("id", "t").toPandas()
    assert len(curve) == 9 and all((np.diff(g["survival"]) <= 0).all() for _, g in curve.groupby("id"))
    none = df.withColumn("event", F.lit(0))
    assert DeepSurv(["a"], epochs=2).fit(none).curve(none.where("id = 0"), "id", [1.0]).first().survival == 1.0


def test_known_times_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(survival, "KNOWN", 50)
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") + 1).cast("double").alias("duration"), F.lit(1).alias("event"))
    model = CoxModel(["a"]).fit(df)
    assert len(model.fitted["times"]) <= 50
    base = {r.t: -np.log(r.survival) for r in model.curve(df.where("a = 0").limit(1), "id", [3.2, 100.0, 1e9]).collect()}
    assert len(base) == 3 and all(v > 0 for v in base.values())
