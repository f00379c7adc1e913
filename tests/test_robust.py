"""Samples of tables with equal rows, covariances of least determinant, ordered logistic states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.detectors import IsolationForest, RobustCovariance, chi_square_quantile, sample_matrix
from tidewatch.operators.scoring import average_run_length
from tidewatch.operators.supervised import ProportionalOdds, ordinal_sums


def test_equal_rows_are_drawn_one_by_one(spark):
    df = spark.range(60_000).select(F.pmod("id", F.lit(10)).cast("double").alias("value"))
    x = sample_matrix(df, ["value"], 3, 5000)[:, 0]
    assert len(x) == 5000 and (np.bincount(x.astype(int), minlength=10) > 350).all()
    assert (sample_matrix(df.repartition(7), ["value"], 3, 5000)[:, 0] == x).all()
    out = IsolationForest(n_estimators=30).fit(df).transform(df)
    assert out.where("flag = 1").count() <= 0.05 * 60_000
    odd = df.unionByName(spark.createDataFrame([(99.0,)] * 500, "value double"))
    out = IsolationForest(n_estimators=30, contamination=0.02).fit(odd).transform(odd).where("flag = 1")
    assert {r.value for r in out.select("value").distinct().collect()} == {99.0} and out.count() == 500


def test_chi_square_quantiles():
    for p, d, want in ((0.5, 1, 0.454936), (0.975, 2, 7.377759), (0.975, 10, 20.483177)):
        assert chi_square_quantile(p, d) == pytest.approx(want, abs=1e-5)


def test_a_large_cluster_of_outliers_is_left_out(spark):
    rng = np.random.default_rng(0)
    good = rng.multivariate_normal([0, 0, 0], [[1, 0.5, 0], [0.5, 1, 0], [0, 0, 2]], 1300)
    bad = rng.multivariate_normal([4, -4, 5], np.eye(3) * 0.3, 700)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(np.concatenate([good, bad]))], "id long, a double, b double, c double")
    model = RobustCovariance(("a", "b", "c"), contamination=0.35, support=0.6).fit(df)
    out = {r.id: r.flag for r in model.transform(df).collect()}
    assert sum(out[i] for i in range(1300)) < 40 and sum(out[i] for i in range(1300, 2000)) > 660
    assert np.allclose(model.fitted["mean"], 0, atol=0.2)
    cov = np.linalg.inv(np.array(model.fitted["precision"]))
    assert np.allclose(cov, [[1, 0.5, 0], [0.5, 1, 0], [0, 0, 2]], atol=0.3)


def test_least_determinant_equals_a_plain_search(spark):
    """On one column the closest half is an interval of the sorted values: the narrowest by variance."""
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.normal(0, 1, 60), rng.normal(9, 0.7, 40)]))
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    model = RobustCovariance(support=0.55).fit(df)
    h = 55
    best = min((x[i : i + h] for i in range(len(x) - h + 1)), key=np.var)
    assert abs(model.fitted["mean"][0] - x[(x >= best.min() - 1.5) & (x <= best.max() + 1.5)].mean()) < 0.35


@pytest.fixture(scope="module")
def states(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 3))
    level = x @ [1.5, -1.0, 0.0] + rng.logistic(size=600)
    y = (level > -1).astype(int) + (level > 1.2)
    return x, y, spark.createDataFrame([(i, a.tolist(), *map(float, a), int(k)) for i, (a, k) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, a double, b double, c double, health_state int")


def test_ordinal_sums_are_derivatives(states):
    x, y, _ = states
    at = np.array([-0.7, 0.9, 0.3, -0.2, 0.5])
    total = ordinal_sums(x, y, at[:2], at[2:])
    for i in range(5):
        step = np.eye(5)[i] * 1e-5
        high, low = (ordinal_sums(x, y, (at + s)[:2], (at + s)[2:]) for s in (step, -step))
        assert total[0, 1 + i] == pytest.approx((high[0, 0] - low[0, 0]) / 2e-5, abs=1e-4)
        assert np.allclose(total[1 + i, 1:], (high[0, 1:] - low[0, 1:]) / 2e-5, atol=1e-4)


def test_proportional_odds(states):
    x, y, df = states
    model = ProportionalOdds(["x"]).fit(df)
    cuts, slope = np.array(model.fitted["cuts"]), np.array(model.fitted["slope"])
    assert cuts[0] < cuts[1] and ProportionalOdds(["a", "b", "c"]).fit(df).fitted["slope"] == pytest.approx(slope.tolist())
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    place = np.zeros(5)  # the same by plain gradient steps
    place[1] = 1.0
    for _ in range(4000):
        place += 0.003 * (ordinal_sums(z, y, place[:2], place[2:])[0, 1:] - np.array([0, 0, 1, 1, 1]) * place)
    assert np.allclose(np.concatenate([cuts, slope]), place, atol=1e-5)
    out = model.transform(df).toPandas().sort_values("id")
    p = np.array(out["probabilities"].tolist())
    upto = 1 / (1 + np.exp((z @ slope)[:, None] - cuts))
    assert np.allclose(p[:, 0], upto[:, 0]) and np.allclose(p[:, 2], 1 - upto[:, 1]) and (out["prediction"] == p.argmax(axis=1)).all()
    assert (out["prediction"] == y).mean() > 0.6
    some = df.withColumn("a", F.when(F.col("id") > 0, F.col("a")))
    assert [r.prediction for r in ProportionalOdds(["a", "b", "c"]).fit(some).transform(some).where("id = 0").collect()] == [None]
    with pytest.raises(ValueError):
        ProportionalOdds(["x"]).fit(df.withColumn("health_state", F.lit(None).cast("int")))


def test_run_lengths_by_order(spark):
    rows = [(g, i, f) for g, flags in (("a", [0, 0, 1, 1, 1, 0, 1, 0, 0]), ("b", [0] * 4), ("c", [1, 1])) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "g string, at int, flag int").repartition(3)
    assert {r.g: r.avg_run_length for r in average_run_length(df, "flag", "at", ("g",)).collect()} == {"a": 2.0, "b": 0.0, "c": 2.0}
    assert average_run_length(df.where("g = 'b'"), "flag", "at").first()[0] == 0.0
