"""ARIMA by exact likelihood against dense Gaussian densities, and as an operator on many series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import arima, detectors


def gaussian(w, phi, theta, mean=0.0):
    """Log density with the likeliest variance, by the covariance matrix of all values at once."""
    n, weights = len(w), np.zeros(3000)
    ma = [1.0, *theta]
    for j in range(len(weights)):
        weights[j] = (ma[j] if j < len(ma) else 0) + sum(f * weights[j - 1 - i] for i, f in enumerate(phi) if j > i)
    by_lag = np.array([weights[: len(weights) - h] @ weights[h:] for h in range(n)])
    cov = by_lag[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    variance = (w - mean) @ np.linalg.solve(cov, w - mean) / n
    return -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + np.linalg.slogdet(cov)[1])


def made(rng, n, phi, theta):
    e, y = rng.standard_normal(n), np.zeros(n)
    for t in range(n):
        y[t] = e[t] + (phi * y[t - 1] + theta * e[t - 1] if t else 0)
    return y


@pytest.mark.parametrize("phi, theta", [([0.5, -0.3], [0.4, 0.2, 0.1]), ([0.9], []), ([], [-0.7]), ([0.3], [0.3]), ([], [])])
def test_likelihood_is_the_gaussian_one(phi, theta):
    rng = np.random.default_rng(1)
    series = [rng.standard_normal(n) for n in (12, 30, 45)]  # padded to the longest
    w, held = arima._padded(series, [0, 1, 2])
    many = lambda x: np.tile(np.array(x, float), (3, 1))
    got = arima.likelihood(w, held, many(phi), many(theta), False)[0]
    assert got == pytest.approx([gaussian(x, phi, theta) for x in series], abs=1e-8)
    got, mean, _ = arima.likelihood(w, held, many(phi), many(theta), True)
    assert got == pytest.approx([gaussian(x, phi, theta, m) for x, m in zip(series, mean, strict=True)], abs=1e-8)
    assert all(g >= gaussian(x, phi, theta, m + dx) for g, x, m in zip(got, series, mean, strict=True) for dx in (-0.05, 0.05))


def test_coefficients_are_stationary_and_cover():
    free = np.random.default_rng(2).standard_normal((200, 3)) * 2
    for row in arima.stable(free):
        assert np.abs(np.roots([1, *-row])).max() < 1


def test_no_grid_point_is_likelier():
    rng = np.random.default_rng(3)
    series = [made(rng, 60, 0.6, 0.3), made(rng, 90, -0.4, 0.5) * 1e4, made(rng, 50, 0.0, -0.8) * 1e-4]
    for x, (_, beta, deviation, loglik) in zip(series, arima.fit_many(series, 1, 0, 1), strict=True):
        at = beta[1:2], beta[2:]
        mean = arima.likelihood(x[None], np.ones((1, len(x)), bool), np.array([at[0]]), np.array([at[1]]), True)[1][0]
        assert loglik == pytest.approx(gaussian(x, *at, mean), abs=1e-5) and deviation > 0
        grid = np.linspace(-0.95, 0.95, 20)
        best = max(arima.likelihood(x[None], np.ones((1, len(x)), bool), np.array([[a]]), np.array([[b]]), True)[0][0] for a in grid for b in grid)
        assert loglik >= best - 1e-6


def test_short_constant_and_empty_series():
    got = arima.fit_many([np.ones(50), np.arange(4.0), np.zeros(0)], 1, 1, 1)
    assert got[0][2] == 0 and [g[2:] for g in got[1:]] == [(None, None)] * 2


def test_a_series_scores_alike_alone_and_among_many(spark):
    """Keys may be null, values missing, rows repeated in number only; padding and company change nothing."""
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v), "x") for k, n in (("a", 80), ("b", 33), (None, 50), ("c", 3)) for i, v in enumerate(np.cumsum(made(rng, n, 0.5, 0.2)))]
    rows += [("d", i, None, "x") for i in range(12)] + [("a", 80, None, "x")]
    df = spark.createDataFrame(rows, "k string, i int, v double, score_of string")
    got = detectors.arima_drift(df, "v", ["k"], ["i"]).toPandas()
    assert len(got) == len(rows) and set(got["flag"]) <= {0, 1} and (got[got.k.isin(["c", "d"])]["score"] == 0).all()
    for k in ("a", "b"):
        alone = detectors.arima_drift(df.where(F.col("k") == k), "v", ["k"], ["i"]).orderBy("i").toPandas()
        assert alone["score"].to_numpy() == pytest.approx(got[got.k == k].sort_values("i")["score"].to_numpy(), abs=1e-6)
    x = np.array([r[2] for r in rows if r[0] == "b"])
    _, beta, deviation, _ = arima.fit_many([x], 1, 1, 1)[0]
    w, e, phi, theta = np.diff(x), [], beta[1], beta[2]
    cov = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)  # the variance before the first value, then by the plain recursion
    state, scale = 0.0, cov
    for value in w:
        e.append(value - state)
        gain = phi + theta / scale
        state, scale = phi * state + gain * e[-1], 1 + theta**2 - theta**2 / scale
    assert got[got.k == "b"].sort_values("i")["score"].to_numpy()[1:] == pytest.approx(np.abs(e) / deviation, abs=1e-6)
    assert detectors.arima_drift(df.where("false"), "v", ["k"], ["i"]).count() == 0
    whole = detectors.arima_drift(df.where("k = 'b'"), "v", [], ["i"]).orderBy("i").toPandas()
    assert whole["score"].to_numpy() == pytest.approx(got[got.k == "b"].sort_values("i")["score"].to_numpy(), abs=1e-6)


def test_moving_average_errors_beat_least_squares(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame([(k, i, v) for k in range(20) for i, v in enumerate(np.cumsum(made(rng, 40, 0.0, -0.8)))], columns=["k", "i", "v"]))
    far = {}
    for exact in (True, False):
        beta = detectors.arima_fit(df, "v", ["k"], ["i"], 0, 1, 1, exact).toPandas()["beta"]
        far[exact] = np.mean([(b[-1] + 0.8) ** 2 for b in beta])
    assert far[True] < far[False]


def test_series_that_are_found_are_not_searched_on(monkeypatch):
    """What a series gets doesn't hang on the others, and the last evaluations are of few of them."""
    rng = np.random.default_rng(4)
    series = [np.cumsum(rng.normal(size=60 + i % 3)) for i in range(40)]
    asked, likelihood = [], arima.likelihood
    monkeypatch.setattr(arima, "likelihood", lambda w, *rest: asked.append(len(w)) or likelihood(w, *rest))
    together = arima.fit_many(series, 1, 1, 1)
    assert asked[-2] <= 8 * len(series) // 2  # the last round's steps; each of eight lengths for each series left
    for x, found in zip(series[:5], together, strict=False):
        alone = arima.fit_many([x], 1, 1, 1)[0]
        assert abs(alone[3] - found[3]) < 1e-7
