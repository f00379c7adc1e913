"""Cox with tied failures and elastic net, parametric fits as sums of the table, and time-dependent concordance, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import survival
from tidewatch.operators.survival import CoxModel, ParametricSurvival, elastic_step, evaluate_survival, time_dependent_concordance

COLUMNS = ["a", "b", "c"]


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    t = np.ceil(8 * rng.exponential(np.exp(-0.9 * x[:, 0] + 0.3 * x[:, 1])))  # many ties
    end = rng.integers(3, 30, n)
    return pd.DataFrame({"id": range(n), **dict(zip(COLUMNS, x.T, strict=True)), "duration": np.minimum(t, end).astype(float), "event": (t <= end).astype(int)})


def log_likelihood(z, t, e, beta, efron):
    w, out = np.exp(z @ beta), 0.0
    for at in np.unique(t[e == 1]):
        dead = (t == at) & (e == 1)
        held, died, d = w[t >= at].sum(), w[dead].sum(), dead.sum()
        out += (z[dead] @ beta).sum() - sum(math.log(held - (i / d if efron else 0) * died) for i in range(d))
    return out


def slopes(f, beta, h=1e-5):
    return np.array([(f(beta + h * u) - f(beta - h * u)) / (2 * h) for u in np.eye(len(beta))])


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_stands_at_the_top_of_the_plain_likelihood(spark, monkeypatch, ties):
    monkeypatch.setattr(survival, "TIES", 4)  # ties of several blocks
    rows = sample(400)
    model = CoxModel(COLUMNS, ties=ties).fit(spark.createDataFrame(rows))
    x = rows[COLUMNS].to_numpy()
    z, beta = (x - x.mean(axis=0)) / x.std(axis=0), np.array(model.fitted["beta"])
    t, e = rows.duration.to_numpy(), rows.event.to_numpy()
    assert np.abs(slopes(lambda b: log_likelihood(z, t, e, b, ties == "efron"), beta)).max() < 1e-3
    assert beta[0] > 0.6
    with pytest.raises(ValueError):
        CoxModel(COLUMNS, ties="other").fit(spark.createDataFrame(rows))


def test_elastic_net_gives_zeros_and_meets_its_conditions(spark):
    rows = sample(400, 1)
    penalty, share, n = 0.15, 0.8, len(rows)
    model = CoxModel(COLUMNS, penalty=penalty, l1_ratio=share).fit(spark.createDataFrame(rows))
    x = rows[COLUMNS].to_numpy()
    z, beta = (x - x.mean(axis=0)) / x.std(axis=0), np.array(model.fitted["beta"])
    assert (beta == 0).any() and beta[0] > 0
    pull = slopes(lambda b: log_likelihood(z, rows.duration.to_numpy(), rows.event.to_numpy(), b, True), beta) - n * penalty * (1 - share) * beta
    free = beta != 0
    assert np.abs(pull[free] - n * penalty * share * np.sign(beta[free])).max() < 1e-2
    assert (np.abs(pull[~free]) <= n * penalty * share + 1e-6).all()
    assert elastic_step(np.zeros(2), np.array([1.0, 3.0]), np.eye(2), 2.0, 0.0).tolist() == [0.0, 1.0]


@pytest.mark.parametrize("kind", ["exponential", "weibull", "lognormal", "loglogistic", "generalized_gamma", "spline"])
def test_parametric_fit_is_a_minimum_of_its_loss(spark, kind):
    rng = np.random.default_rng(3)
    t = 2.0 * rng.weibull(1.4, 600)
    rows = pd.DataFrame({"duration": np.minimum(t, 3.0), "event": (t < 3).astype(int)})
    model = ParametricSurvival(kind, (0.3, 0.9, 1.8, 2.8)).fit(spark.createDataFrame(rows))
    t, d, n = rows.duration.to_numpy(), rows.event.to_numpy(float), np.ones(len(rows))
    theta = np.array(model.theta)
    loss = lambda x: model.loss_at(x, t, d, n) / len(rows)
    assert np.abs(slopes(loss, theta)).max() < 1e-3
    model.theta = theta.tolist()
    s = model.survival_at(t * (1 + 1e-5))
    s = (model.survival_at(t * (1 - 1e-5)) - s) / (2e-5 * t)
    assert np.allclose(np.log(s), model._log_density(t), atol=1e-3)  # the density is the curve's slope
    with pytest.raises(ValueError):
        ParametricSurvival(kind).fit(spark.createDataFrame([], "duration double, event int"))


def plain_index(s, grid, t, e):
    """All ordered pairs."""
    at = np.clip(np.searchsorted(grid, t, "right") - 1, 0, None)
    half = lambda a, b: float(a < b) + 0.5 * float(a == b)
    won = pairs = 0
    for i in range(len(t)):
        for j in range(len(t)):
            a, b = s[i, at[i]], s[j, at[i]]
            if i == j or not ((t[i] < t[j] and e[i]) or (t[i] == t[j] and (e[i] or e[j]))):
                continue
            pairs += 1
            if t[i] < t[j]:
                won += half(a, b)
            elif e[i] and e[j]:
                won += 1.0 if a == b else 0.5
            else:
                won += half(a, b) if e[i] else half(b, a)
    return won / pairs, pairs


@pytest.mark.parametrize("seed", range(4))
def test_time_dependent_concordance_by_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    n, grid = 40, np.array([2.0, 3.0, 5.0, 8.0, 9.0])
    s = np.sort(np.round(rng.random((n, len(grid))), 1), axis=1)[:, ::-1]  # ties and crossing curves
    t, e = rng.integers(1, 11, n).astype(float), rng.integers(0, 2, n)
    curve = spark.createDataFrame([(i, float(x), float(s[i, k])) for i in range(n) for k, x in enumerate(grid)], "id int, t double, survival double")
    truth = spark.createDataFrame([(i, float(t[i]), int(e[i])) for i in range(n)] + [(None, 3.0, 1), (99, 2.0, 1), (0, None, 1)], "id int, duration double, event int")
    got = time_dependent_concordance(curve, truth, "id").first()
    index, pairs = plain_index(s, grid, t, e)
    assert got.pairs == pairs and got.concordance_td == pytest.approx(index)
    none = time_dependent_concordance(curve, truth.limit(0), "id").first()
    assert none.pairs == 0 and none.concordance_td == 0.5
    whole = evaluate_survival(curve, truth.where("id < 99"), "id").first()
    median = np.array([grid[np.argmax(r <= 0.5)] if (r <= 0.5).any() else grid[-1] for r in s])
    assert whole.concordance_td == pytest.approx(index) and whole.mae == pytest.approx(np.abs(median - t).mean())
