"""Survival analysis: curves from grouped counts, Cox regression from risk-set sums, discrete hazards, evaluation.

Curves are long: one row for each time. Counts are grouped by duration first, so what the driver optimises over
is as large as the number of distinct durations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidewatch.functions.rules import health_from_rul
from tidewatch.operators.detectors import by_matrix, moments
from tidewatch.operators.ordering import running
from tidewatch.operators.recurrent import _dealt, dense, dense_gradient, dense_weights, trained
from tidewatch.operators.scoring import NotFitted
from tidewatch.sources.scratch import cut

#: Up to so many distinct durations are summed in one task of a Newton step (some 100 MB); beyond that by ranges.
ONE_TASK, KNOWN = 500_000, 10_000
#: So many failures of one duration are corrected for their tie in one row.
TIES = 4096


def kaplan_meier(df: DataFrame, duration: str = "duration", event: str = "event", by: tuple[str, ...] = ()) -> DataFrame:
    """t, at_risk, deaths, survival and its Greenwood standard error at each duration."""
    counts = df.groupBy(*by, F.col(duration).alias("t")).agg(F.sum(F.col(event).cast("long")).alias("deaths"), F.count(F.lit(1)).alias("n"))
    if by:
        later = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("at_risk", F.sum("n").over(later))
    else:
        counts = running(counts, [F.desc("t")], {"at_risk": F.col("n")})
    alive = F.col("at_risk") - F.col("deaths")  # 0 at the last duration only
    steps = {"_log": F.when(alive > 0, F.log(alive / F.col("at_risk"))).otherwise(0.0), "_spread": F.when(alive > 0, F.col("deaths") / (F.col("at_risk") * alive)).otherwise(0.0)}
    if by:
        upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumns({k: F.sum(x).over(upto) for k, x in steps.items()})
    else:
        counts = running(counts, [F.col("t")], steps)
    counts = counts.withColumn("survival", F.when(alive == 0, 0.0).otherwise(F.exp("_log")))
    counts = counts.withColumn("std_error", F.col("survival") * F.sqrt("_spread"))
    reach = 1.959963984540054 * F.col("std_error")  # a 95 % interval
    counts = counts.withColumn("lower", F.greatest(F.col("survival") - reach, F.lit(0.0))).withColumn("upper", F.least(F.col("survival") + reach, F.lit(1.0)))
    return counts.drop("n", "_log", "_spread")


def quantile_time(curve: DataFrame, q: float = 0.5, by: tuple[str, ...] = (), strict: bool = False, last: bool = True) -> DataFrame:
    """The first time at which survival is at most q (below q if strict); else the last time, or infinity."""
    s = F.col("survival") < q if strict else F.col("survival") <= q
    reached = F.min(F.when(s, F.col("t").cast("double")))
    return curve.groupBy(*by).agg(F.coalesce(reached, F.max(F.col("t").cast("double")) if last else F.lit(float("inf"))).alias("time"))


def time_to_failure(curve: DataFrame, by: tuple[str, ...], probability: float = 0.5) -> DataFrame:
    return quantile_time(curve, probability, by, strict=True)


def piecewise_hazards(df: DataFrame, breaks: tuple[float, ...] = (40.0, 60.0), duration: str = "duration", event: str = "event") -> DataFrame:
    """interval, events, exposure, hazard of a piecewise exponential model: events over time at risk."""
    edges = [0.0, *breaks, float("inf")]
    t = F.col(duration).cast("double")
    rows = [F.struct(F.lit(i).alias("interval"), F.greatest(F.least(t, F.lit(b)) - a, F.lit(0.0)).alias("x"), F.when((t > a) & (t <= b) | ((t == 0) & (a == 0)), F.col(event)).otherwise(0).alias("d")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    long = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.groupBy("interval").agg(F.sum("d").cast("long").alias("events"), F.sum("x").alias("exposure")).withColumn("hazard", F.coalesce(F.try_divide(F.col("events").cast("double"), F.col("exposure")), F.lit(0.0)))


def _normal_sf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def _survival_of(kind: str, theta: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b = np.exp(theta[0]), np.exp(theta[1]) if len(theta) > 1 else 1.0
    t = np.maximum(t, 1e-12)
    if kind == "exponential":
        return np.exp(-t / a)
    if kind == "weibull":
        return np.exp(-((t / a) ** b))
    if kind == "loglogistic":
        return 1 / (1 + (t / a) ** b)
    if kind == "lognormal":
        return _normal_sf((np.log(t) - theta[0]) / b)
    if kind == "generalized_gamma":  # by the regularised incomplete gamma function of shape k, as a series
        k = np.exp(theta[2])
        x = np.minimum((t / a) ** b, 700.0)
        term = np.exp(-x + k * np.log(np.maximum(x, 1e-300)) - math.lgamma(k + 1))
        total = term.copy()
        for i in range(1, 600):
            term = term * x / (k + i)
            total += term
        return np.clip(1 - total, 0, 1)
    raise ValueError(f"unknown model {kind!r}")


@dataclass
class ParametricSurvival:
    """weibull, exponential, lognormal, loglogistic, generalized_gamma, or spline (log cumulative hazard over log time)."""

    kind: str = "weibull"
    knots: tuple[float, ...] = (6.0, 20.0, 40.0, 75.0)
    theta: list[float] = field(default_factory=list, init=False)

    def _basis(self, t: np.ndarray) -> np.ndarray:
        x, k = np.log(np.maximum(t, 1e-12)), np.log(np.array(self.knots))
        cube = lambda u: np.maximum(u, 0) ** 3
        part = [(k[-1] - k[j]) / (k[-1] - k[0]) for j in range(1, len(k) - 1)]
        return np.column_stack([np.ones(len(x)), x, *[cube(x - k[j + 1]) - p * cube(x - k[0]) - (1 - p) * cube(x - k[-1]) for j, p in enumerate(part)]])

    def survival_at(self, t: np.ndarray) -> np.ndarray:
        if not self.theta:
            raise NotFitted("ParametricSurvival is not fitted")
        t = np.asarray(t, float)
        if self.kind == "spline":
            return np.exp(-np.exp(np.clip(self._basis(t) @ np.array(self.theta), -30, 30)))
        return _survival_of(self.kind, np.array(self.theta), t)

    def _log_density(self, t: np.ndarray) -> np.ndarray:
        theta, x = np.array(self.theta), np.log(t)
        if self.kind == "spline":
            h = np.clip(self._basis(t) @ theta, -30, 30)
            near = 1e-5
            slope = (self._basis(t * np.exp(near)) - self._basis(t * np.exp(-near))) @ theta / (2 * near)
            return h + np.log(np.maximum(slope, 1e-12)) - x - np.exp(h)
        b = theta[1] if len(theta) > 1 else 0.0
        z = np.exp(b) * (x - theta[0])  # the logarithm of (t / a) ** b
        if self.kind in ("exponential", "weibull"):
            return b + z - x - np.exp(np.minimum(z, 700))
        if self.kind == "loglogistic":
            return b + z - x - 2 * np.logaddexp(0, z)
        if self.kind == "lognormal":
            return -x - b - 0.5 * math.log(2 * math.pi) - 0.5 * ((x - theta[0]) / np.exp(b)) ** 2
        k = math.exp(theta[2])
        return b + k * z - x - np.exp(np.minimum(z, 700)) - math.lgamma(k)

    def loss_at(self, theta: np.ndarray, t: np.ndarray, d: np.ndarray, n: np.ndarray) -> float:
        """Minus the log likelihood of n rows of each duration, of which d fail."""
        self.theta = np.asarray(theta, float).tolist()
        alive = np.where(n > d, np.log(np.maximum(self.survival_at(t), 1e-300)), 0.0)
        value = -(d * self._log_density(t) + (n - d) * alive).sum()
        return float(value) if np.isfinite(value) else 1e300

    def fit(self, df: DataFrame, duration: str = "duration", event: str = "event") -> ParametricSurvival:
        """Newton steps; the likelihood at all points that a step looks at is one sum over the table, so no durations come to the driver.

        Durations under 1e-6 count as that; rows without one are left out. An empty table is an error.
        """
        rows = df.select(F.greatest(F.col(duration).cast("double"), F.lit(1e-6)).alias("t"), F.coalesce(F.col(event).cast("double"), F.lit(0.0)).alias("e")).where(F.col(duration).isNotNull())
        rows = cut(rows.groupBy("t").agg(F.sum("e").alias("d"), F.count(F.lit(1)).cast("double").alias("n")), "durations")
        time, deaths, n = rows.agg(F.sum(F.col("t") * F.col("n")), F.sum("d"), F.sum("n")).first()
        if not n:
            raise ValueError("nothing to learn from")
        kind, knots = self.kind, self.knots

        def losses(thetas: np.ndarray) -> np.ndarray:
            def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                model, total = ParametricSurvival(kind, knots), np.zeros(len(thetas))
                for rows in batches:
                    t, d, n = (rows[c].to_numpy(float) for c in ("t", "d", "n"))
                    total += [model.loss_at(theta, t, d, n) for theta in thetas]
                yield pd.DataFrame({"i": range(len(thetas)), "x": total})

            out = np.zeros(len(thetas))
            for r in rows.mapInPandas(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # one row a point
                out[r.i] = r.x / n
            return out

        mean = math.log(time / max(deaths, 1.0))
        theta = np.array({"exponential": [mean], "generalized_gamma": [mean, 0.0, 0.0], "spline": [-mean, 1.0, *[0.0] * (len(knots) - 2)]}.get(kind, [mean, 0.0]))
        self.theta = newton(losses, theta).tolist()
        return self

    def curve(self, df: DataFrame, times: list[float]) -> DataFrame:
        """t and survival at the times."""
        return df.sparkSession.createDataFrame([(float(t), float(s)) for t, s in zip(times, self.survival_at(np.array(times)), strict=True)], "t double, survival double")


class SurvivalModel:
    """Extension point: ``fit(df, duration, event)`` learns, ``curve(df, key)`` gives key, t, survival; the rest follows from the curve."""

    fitted: dict

    def fit(self, df: DataFrame, duration: str = "duration", event: str = "event") -> SurvivalModel:
        raise NotImplementedError

    def curve(self, df: DataFrame, key: str) -> DataFrame:
        raise NotImplementedError

    def is_fitted(self) -> bool:
        return bool(self.fitted)

    def need_fit(self) -> None:
        if not self.is_fitted():
            raise NotFitted(f"{type(self).__name__} is not fitted")

    def time_to_failure(self, df: DataFrame, key: str, probability: float = 0.5) -> DataFrame:
        """key and the first time at which survival is below a probability; the last time if it never is."""
        return time_to_failure(self.curve(df, key), (key,), probability)

    def risk(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with risk_score: minus the median survival time of its key (the first time at which survival is at most a half)."""
        median = quantile_time(self.curve(df, key), 0.5, (key,))
        return df.join(median.select(key, (-F.col("time")).alias("risk_score")), key, "left")


def newton(losses: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 40, h: float = 1e-3) -> np.ndarray:
    """The smallest loss by Newton steps on central differences; ``losses`` takes all points of a step at once."""
    k, at = len(start), start.astype(float)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    unit = np.eye(k) * h
    for _ in range(steps):
        near = [at, *[at + s * unit[i] for i in range(k) for s in (1, -1)], *[at + a * unit[i] + b * unit[j] for i, j in pairs for a in (1, -1) for b in (1, -1)]]
        v = losses(np.array(near))
        up, down = v[1 : 2 * k + 1 : 2], v[2 : 2 * k + 1 : 2]
        slope, bend = (up - down) / (2 * h), np.diag((up - 2 * v[0] + down) / h**2)
        for (i, j), c in zip(pairs, v[2 * k + 1 :].reshape(-1, 4), strict=True):
            bend[i, j] = bend[j, i] = (c[0] - c[1] - c[2] + c[3]) / (4 * h * h)
        value, vector = np.linalg.eigh(bend)
        move = -vector @ ((vector.T @ slope) / np.maximum(np.abs(value), 1e-6))
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-300))
        if np.abs(move).max() < 1e-7:
            break
        parts = 0.5 ** np.arange(12)
        tried = losses(at + parts[:, None] * move)
        best = int(np.argmin(tried))
        if tried[best] >= v[0]:
            break
        at = at + parts[best] * move
    return at


def _tie_sums(deaths: Column, held: Column, died: Column, block: Column, efron: bool) -> Column:
    """Of the l = 0 .. deaths - 1 that die together, with u = l / deaths (0 without correction) and p = 1 / (held - u died): the sums of
    p, u p, p^2, u p^2 and u^2 p^2 over one block of l."""
    if not efron:
        p = deaths / held
        return F.struct(p.alias("p0"), F.lit(0.0).alias("p1"), (p / held).alias("q0"), F.lit(0.0).alias("q1"), F.lit(0.0).alias("q2"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("p0", "p1", "q0", "q1", "q2")])

    def add(total: Column, at: Column) -> Column:
        u = at.cast("double") / deaths
        p = F.lit(1.0) / (held - u * died)
        return F.struct(*[(total[c] + x).alias(c) for c, x in (("p0", p), ("p1", u * p), ("q0", p * p), ("q1", u * p * p), ("q2", u * u * p * p))])

    first = block * TIES
    return F.aggregate(F.sequence(first, F.least(first + TIES, deaths.cast("long")) - 1), start, add)


def elastic_step(beta: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l1: float, l2: float, sweeps: int = 1000) -> np.ndarray:
    """The step to the top of gradient.s - s.curvature.s / 2 - l1 |beta + s| - l2 |beta + s|^2 / 2, by coordinates with soft thresholds."""
    if not l1:
        return np.linalg.solve(curvature + l2 * np.eye(len(beta)), gradient - l2 * beta)
    new, rest = beta.copy(), gradient + curvature @ beta
    for _ in range(sweeps):
        before = new.copy()
        for i in range(len(new)):
            pull = rest[i] - curvature[i] @ new + curvature[i, i] * new[i]
            new[i] = np.sign(pull) * max(abs(pull) - l1, 0.0) / (curvature[i, i] + l2)
        if np.abs(new - before).max() < 1e-12:
            break
    return new - beta


@dataclass
class CoxModel(SurvivalModel):
    """Proportional hazards by Newton steps on the partial likelihood, ties by Efron's correction (or "breslow").

    The mean log likelihood loses ``penalty * (l1_ratio |b| + (1 - l1_ratio) b^2 / 2)`` of the coefficients of standardised columns; with
    an ``l1_ratio`` a step goes by coordinates with soft thresholds, so that coefficients become exactly 0. ``degree`` 2 adds squares and
    products of the features. Each step groups the rows by duration and sums over the risk sets with a window over the distinct durations;
    failures of one duration are corrected in blocks of ``TIES``.
    """

    features: list[str] = field(default_factory=list)
    penalty: float = 0.0
    degree: int = 1
    steps: int = 25
    l1_ratio: float = 0.0
    ties: str = "efron"
    fitted: dict = field(default_factory=dict, init=False)

    def _columns(self) -> list[Column]:
        z = [(F.col(c).cast("double") - m) / s for c, m, s in zip(self.features, self.fitted["mean"], self.fitted["std"], strict=True)]
        return z if self.degree == 1 else [*z, *[z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]]

    def log_risk(self) -> Column:
        return sum((x * float(b) for x, b in zip(self._columns(), self.fitted["beta"], strict=True)), F.lit(0.0))

    def fit(self, df: DataFrame, duration: str = "duration", event: str = "event") -> CoxModel:
        if self.ties not in ("efron", "breslow"):
            raise ValueError(f"unknown ties {self.ties!r}")
        r = df.agg(*[F.avg(c) for c in self.features], *[F.stddev_pop(c) for c in self.features], F.count(F.lit(1))).first()
        k, n = len(self.features), max(r[-1], 1)
        self.fitted = {"mean": [m or 0.0 for m in r[:k]], "std": [s or 1.0 for s in r[k:-1]]}
        d = len(self._columns())
        beta = np.zeros(d)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        few = df.select(F.col(duration).cast("double")).distinct().count() <= ONE_TASK
        names = ["s", *[f"a{i}" for i in range(d)], *[f"b{i}_{j}" for i, j in pairs]]

        def later(times: DataFrame) -> DataFrame:
            """Sums over the durations from each one on."""
            if not few:
                return running(times, [F.desc("t")], {f"_{c}": F.col(c) for c in names}).drop(*names).withColumnsRenamed({f"_{c}": c for c in names})
            w = Window.partitionBy(F.lit(0)).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
            return times.withColumns({c: F.sum(c).over(w) for c in names})

        for _ in range(self.steps):
            self.fitted["beta"] = beta.tolist()
            rows = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("e"), F.exp(self.log_risk()).alias("w"), *[x.alias(f"x{i}") for i, x in enumerate(self._columns())])
            each = {"s": F.col("w"), **{f"a{i}": F.col("w") * F.col(f"x{i}") for i in range(d)}, **{f"b{i}_{j}": F.col("w") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
            died = [F.sum(F.col("e") * x).alias(f"d_{c}") for c, x in each.items()]  # the same sums over those that fail now
            times = rows.groupBy("t").agg(F.sum("e").alias("e"), *[F.sum(x).alias(c) for c, x in each.items()], *died, *[F.sum(F.col("e") * F.col(f"x{i}")).alias(f"c{i}") for i in range(d)])
            risk = later(times).where("e > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("e") - 1) / TIES) if self.ties == "efron" else F.lit(0).cast("long"))))
            risk = risk.withColumn("l", _tie_sums(F.col("e"), F.col("s"), F.col("d_s"), F.col("block"), self.ties == "efron"))
            own, first = lambda c: F.col("l")[c], F.when(F.col("block") == 0, 1.0).otherwise(0.0)
            slope = [F.sum(first * F.col(f"c{i}") - F.col(f"a{i}") * own("p0") + F.col(f"d_a{i}") * own("p1")) for i in range(d)]
            bend = []
            for i, j in pairs:
                a, b, x, y = F.col(f"a{i}"), F.col(f"a{j}"), F.col(f"d_a{i}"), F.col(f"d_a{j}")
                bend.append(F.sum(F.col(f"b{i}_{j}") * own("p0") - F.col(f"d_b{i}_{j}") * own("p1") - a * b * own("q0") + (a * y + x * b) * own("q1") - x * y * own("q2")))
            total = risk.agg(*slope, *bend).first()
            gradient = np.array([v or 0.0 for v in total[:d]])
            hessian = np.zeros((d, d))
            for (i, j), v in zip(pairs, total[d:], strict=True):
                hessian[i, j] = hessian[j, i] = v or 0.0
            step = elastic_step(beta, gradient, hessian + np.eye(d) * 1e-9 * n, n * self.penalty * self.l1_ratio, n * self.penalty * (1 - self.l1_ratio))
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.fitted["beta"] = beta.tolist()
        self._baseline(df, duration, event)
        return self

    def _baseline(self, df: DataFrame, duration: str, event: str) -> None:
        """The cumulative hazard at risk 1 over the whole table. At most ``KNOWN`` times stay in the model: all of them, or each at
        which another part of the whole hazard is reached."""
        times = df.groupBy(F.col(duration).cast("double").alias("t")).agg(F.sum(F.col(event).cast("double")).alias("e"), F.sum(F.exp(self.log_risk())).alias("s0"))
        hazard = running(times, [F.desc("t")], {"risk": F.col("s0")}).select("t", (F.col("e") / F.col("risk")).alias("h"))
        steps = cut(running(hazard, [F.col("t")], {"cumulative": F.col("h")}), "hazard")
        if steps.count() > KNOWN:
            whole = steps.agg(F.max("cumulative")).first()[0] or 1.0
            steps = steps.groupBy(F.floor(F.col("cumulative") / whole * (KNOWN - 1)).alias("_part")).agg(F.max(F.struct("t", "cumulative")).alias("s")).select("s.*")
        found = steps.orderBy("t").select("t", "cumulative").collect()
        self.fitted["times"], self.fitted["cumulative"] = [r.t for r in found], [r.cumulative for r in found]

    def risk(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Adds risk_score, the partial hazard."""
        self.need_fit()
        return df.withColumn("risk_score", F.exp(self.log_risk()))

    def curve(self, df: DataFrame, key: str, times: list[float] | None = None) -> DataFrame:
        """key, t, survival: the baseline to the power of the partial hazard, at the nearest known times."""
        self.need_fit()
        known, cumulative = np.array(self.fitted["times"]), np.array(self.fitted["cumulative"])
        times = known if times is None else np.array(times, float)
        right = np.clip(np.searchsorted(known, times), 1, max(1, len(known) - 1))
        left = right - 1
        near = left if len(known) < 2 else np.where(times - known[left] <= known[right] - times, left, right)
        base = df.sparkSession.createDataFrame([(float(t), float(cumulative[i])) for t, i in zip(times, near, strict=True)], "t double, h double")
        return df.select(key, F.exp(self.log_risk()).alias("w")).crossJoin(F.broadcast(base)).select(key, "t", F.exp(-F.col("h") * F.col("w")).alias("survival"))


def partial_likelihood(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, room: dict | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Minus the mean log partial likelihood of a batch (y: duration, event) over its own risk sets, ties as one, and its gradient."""
    risk, held = dense(w, x)
    order = np.argsort(-y[:, 0], kind="stable")
    t, e, eta = y[order, 0], y[order, 1], risk[order, 0]
    lead = eta.max()
    upto = np.cumsum(np.exp(eta - lead))
    last = np.searchsorted(-t, -t, "right") - 1  # the end of the rows of the same duration
    total, failed = upto[last], max(e.sum(), 1.0)
    loss = -(e * (eta - lead - np.log(total))).sum() / failed
    later = np.cumsum((e / total)[::-1])[::-1]  # of the durations up to this one: they come behind
    first = np.searchsorted(-t, -t, "left")
    by = np.zeros((len(x), 1))
    by[order, 0] = (np.exp(eta - lead) * later[first] - e) / failed
    return float(loss), dense_gradient(w, held, by)


@dataclass
class DeepSurv(CoxModel):
    """Proportional hazards whose log risk is a dense network, trained on the partial likelihood of batches.

    A batch has its own risk sets; passes go over bundles in all tasks and weights are averaged between rounds. The baseline
    comes from the risk sets of the whole table. Without a failure there is nothing to learn and the risk stays as it began.
    """

    hidden: tuple[int, ...] = (32, 32)
    epochs: int = 100
    rounds: int = 4
    batch: int = 256
    rate: float = 1e-2
    seed: int = 0

    def log_risk(self) -> Column:
        w = {k: np.array(v) for k, v in self.fitted["weights"].items()}
        mean, std = np.array(self.fitted["mean"]), np.array(self.fitted["std"])
        return by_matrix(self.features, lambda x: dense(w, (x - mean) / std)[0][:, 0])

    def fit(self, df: DataFrame, duration: str = "duration", event: str = "event") -> DeepSurv:
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in self.features], F.col(duration).cast("double").alias("_t"), F.col(event).cast("double").alias("_e")).dropna()
        n, mean, cov = moments(rows, self.features)
        if not n:
            raise ValueError("nothing to learn from")
        std = np.sqrt(np.diag(cov))
        std[std < 1e-12] = 1.0
        names = list(self.features)
        read = lambda part: ((part[names].to_numpy(float) - mean) / std, part[["_t", "_e"]].to_numpy(float))
        start = dense_weights(np.random.default_rng(self.seed), [len(names), *self.hidden, 1])
        w = trained(_dealt(rows), read, start, partial_likelihood, self.epochs, self.rounds, self.batch, self.rate, self.seed)
        self.fitted = {"mean": mean.tolist(), "std": std.tolist(), "weights": {k: v.tolist() for k, v in w.items()}}
        self._baseline(df, duration, event)
        return self


@dataclass
class LogisticHazard(SurvivalModel):
    """Discrete-time hazards: a logistic regression on features and bin, over the bins that each row lives in, gives the hazard.

    The mean log loss of all rows and bins plus ``ridge`` / 2 times the squared coefficients of scaled inputs (all but the constant) is
    smallest by Newton steps. A row meets its bins as a matrix inside its task; bins are never rows of a table, and a step sends a few thousand
    numbers from each task. Missing features are an error; rows without a duration are not learned from.
    """

    features: list[str] = field(default_factory=list)
    n_bins: int = 50
    ridge: float = 1e-4
    fitted: dict = field(default_factory=dict, init=False)

    def fit(self, df: DataFrame, duration: str = "duration", event: str = "event") -> LogisticHazard:
        top = float(df.agg(F.max(duration)).first()[0])
        width = top / self.n_bins or 1.0
        own = F.least(F.floor(F.col(duration) / width), F.lit(self.n_bins - 1)).cast("int")
        failed = F.coalesce((F.col(event) == 1).cast("int"), F.lit(0))
        names = [f"x{i}" for i in range(len(self.features))]
        rows = cut(df.select(own.alias("own"), failed.alias("failed"), *[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names, strict=True)]).where("own >= 0"), "lives")
        if names and rows.where(" OR ".join(f"{n} IS NULL OR isnan({n})" for n in names)).head(1):
            raise ValueError("missing features")
        counts = {r.own: r for r in rows.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("failed")).collect()}  # a row a bin
        bins = max(counts) + 1
        lived = np.cumsum([counts[b].n if b in counts else 0 for b in range(bins)][::-1])[::-1].astype(float)
        n, deaths = lived.sum(), float(sum(r.failed for r in counts.values()))
        shift = dict(enumerate(rows.agg(*[F.sum(F.col(c) * (F.col("own") + 1)) / n for c in names]).first())) if names else {}
        spread = rows.agg(*[F.sum((F.col(c) - shift[i]) ** 2 * (F.col("own") + 1)) / max(n - 1, 1) for i, c in enumerate(names)]).first() if names else ()
        mean = np.array([shift[i] for i in range(len(names))])
        scale = np.sqrt(np.array([*spread, *(lived / n * (1 - lived / n) * n / max(n - 1, 1))], float))
        self.fitted = {"width": width, "mean": mean.tolist(), "beta": [0.0] * len(names), "bins": [0.0] * self.n_bins, "constant": float("-inf") if not deaths else float("inf")}
        if not 0 < deaths < n:
            return self
        learned = np.concatenate([[True], scale > 1e-9 * np.concatenate([np.abs(mean) + 1e-300, np.ones(bins)])])
        unit = np.where(learned[1:], scale, 1.0)
        k = len(names)

        def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """Loss, slope and curvature of the mean log loss and the ridge at weights of scaled inputs."""

            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(1 + (m := 1 + k + bins) + m * m)
                level = w[0] + w[1 + k :] / unit[k:]
                for part in parts:
                    for at in range(0, len(part), 4096):
                        piece = part.iloc[at : at + 4096]
                        x = np.column_stack([np.ones(len(piece)), (piece[names].to_numpy(float) - mean) / unit[:k]])
                        last, dead = piece["own"].to_numpy(), piece["failed"].to_numpy(float)
                        z = (x[:, 1:] @ w[1 : 1 + k])[:, None] + level
                        lives = np.arange(bins) <= last[:, None]
                        e = np.exp(-np.abs(z))
                        h = np.where(z >= 0, 1.0, e) / (1 + e)
                        each = np.arange(len(piece))
                        total[0] += ((np.log1p(e) + np.maximum(z, 0)) * lives).sum() - (dead * z[each, last]).sum()
                        over, bend = h * lives, h * (1 - h) * lives
                        over[each, last] -= dead
                        total[1 : 2 + k] += x.T @ over.sum(1)
                        total[2 + k : 1 + m] += over.sum(0) / unit[k:]
                        curve = total[1 + m :].reshape(m, m)
                        curve[: 1 + k, : 1 + k] += x.T @ (x * bend.sum(1)[:, None])
                        cross = x.T @ bend / unit[k:]
                        curve[: 1 + k, 1 + k :] += cross
                        curve[1 + k :, : 1 + k] += cross.T
                        curve[np.arange(1 + k, m), np.arange(1 + k, m)] += bend.sum(0) / unit[k:] ** 2
                yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

            m = 1 + k + bins
            got = np.zeros(1 + m + m * m)
            for r in rows.mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # a number a curvature
                got[r.i] = r.s
            got /= n
            penalty = np.where(np.arange(m) > 0, self.ridge, 0.0)
            return got[0] + 0.5 * (penalty * w * w).sum(), got[1 : 1 + m] + penalty * w, got[1 + m :].reshape(m, m) + np.diag(penalty)

        w = np.zeros(1 + k + bins)
        w[0] = np.log(deaths / (n - deaths))
        loss, slope, curve = sums(w)
        for _ in range(100):
            step = np.zeros_like(w)
            step[learned] = np.linalg.solve(curve[np.ix_(learned, learned)], slope[learned])
            if slope @ step < 1e-14:
                break
            by, found = 1.0, sums(w - step)
            while found[0] > loss and by > 1e-6:
                by /= 2
                found = sums(w - by * step)
            if found[0] > loss:
                break
            w, (loss, slope, curve) = w - by * step, found
        self.fitted |= {"beta": (w[1 : 1 + k] / unit[:k]).tolist(), "bins": [*(w[1 + k :] / unit[k:]).tolist(), *[0.0] * (self.n_bins - bins)], "constant": float(w[0])}
        return self

    def curve(self, df: DataFrame, key: str) -> DataFrame:
        """key, t, survival: the product of what each bin's hazard leaves, row by row."""
        self.need_fit()
        mean, beta, level = np.array(self.fitted["mean"]), np.array(self.fitted["beta"]), self.fitted["constant"] + np.array(self.fitted["bins"])
        names, (kept, *_) = [f"x{i}" for i in range(len(beta))], df.select(key).schema.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    if any(part.column(c).null_count for c in names):
                        raise ValueError("missing features")
                    x = np.column_stack([np.asarray(part.column(c), float) for c in names]) if names else np.zeros((part.num_rows, 0))
                    z = ((x - mean) @ beta)[:, None] + level
                    left = np.exp(np.cumsum(np.maximum(-np.logaddexp(0, z), np.log(1e-12)), axis=1))
                    ends = np.arange(part.num_rows + 1, dtype=np.int32) * len(level)
                    yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(pa.array(ends), pa.array(left.reshape(-1)))], ["k", "left"])

        rows = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names, strict=True)])
        schema = StructType([StructField("k", kept.dataType), StructField("left", ArrayType(DoubleType()))])
        rows = rows.mapInArrow(run, schema).select(F.col("k").alias(key), F.posexplode("left").alias("bin", "survival"))
        return rows.select(key, ((F.col("bin") + 1) * self.fitted["width"]).alias("t"), "survival")


def survival_model(kind: str, features: list[str], **options):
    """cox (or lifelines), deepsurv, logistic_hazard."""
    made = {"cox": CoxModel, "lifelines": CoxModel, "deepsurv": DeepSurv, "logistic_hazard": LogisticHazard}
    if kind not in made:
        raise ValueError(f"unknown model {kind!r}")
    return made[kind](features, **options)


def _won(rows: DataFrame) -> DataFrame:
    """won: for each asking row of ``rows(g, k, pos, held, asked)``, the held ones of its group of a higher rank, and half of those of its own
    rank, whose pos is smaller. No pair is ever made.

    Of the ranks below one, those that a tree of halved ranges holds apart lie in one node for each bit that is set; every row is a point of
    the nodes on its path, every asking row asks the nodes beside its path. Sorted by node and pos, that is a running sum: n log n rows,
    whatever the ties. Counts are longs; only their products are decimals.
    """
    top = rows.agg(F.max("k")).first()[0] or 0
    rows = rows.withColumn("k", F.lit(top) - F.col("k"))  # the higher ranks lie below
    levels = range(max(1, (top + 1).bit_length()))
    bit = lambda l: F.shiftright("k", l).bitwiseAND(F.lit(1))  # noqa: E731, E741
    node = lambda l, at: F.struct(F.lit(l).alias("level"), at.alias("node"))  # noqa: E731, E741
    points = F.array(node(-1, F.col("k")), *[F.when(bit(l) == 0, node(l, F.shiftright("k", l))) for l in levels])  # noqa: E741
    asks = F.array(node(-1, F.col("k")), *[F.when(bit(l) == 1, node(l, F.shiftright("k", l) - 1)) for l in levels])  # noqa: E741
    none = F.lit(0).cast("long")
    own = rows.where("held > 0").select("g", "pos", F.lit(1).alias("kind"), F.col("held").cast("long").alias("held"), none.alias("asked"), F.explode(points).alias("at"))
    asked = rows.where("asked > 0").select("g", "pos", F.lit(0).alias("kind"), none.alias("held"), F.col("asked").cast("long").alias("asked"), F.explode(asks).alias("at"))
    both = own.unionByName(asked).where("at is not null").select("at.*", "g", "pos", "kind", "held", "asked")
    both = running(both, [F.col("level"), F.col("node"), F.col("g"), F.col("pos"), F.col("kind")], {"upto": F.col("held")})
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = F.when(F.col("asked") > 0, wide("asked") * wide("upto"))
    each = both.groupBy("level", "node", "g").agg(F.min(F.col("upto") - F.col("held")).alias("start"), F.sum("asked").alias("asked"), F.coalesce(F.sum(product), F.lit(0).cast("decimal(38,0)")).alias("found"))
    beaten = F.col("found") - wide("asked") * wide("start")
    return each.agg(F.coalesce(F.sum(F.when(F.col("level") >= 0, 1.0).otherwise(0.5) * beaten.cast("double")), F.lit(0.0)).alias("won"))


def _ranked(rows: DataFrame, value: str) -> DataFrame:
    """Adds k, the rank of a value from 0 on."""
    ranks = running(rows.select(value).distinct(), [F.col(value)], {"k": F.lit(1).cast("long")})
    return rows.join(ranks.withColumn("k", F.col("k") - 1), value)


def concordance(df: DataFrame, duration: str = "duration", risk: str = "risk_score", event: str = "event") -> DataFrame:
    """concordance_index (Harrell), pairs: ties of risk count half. No pair is ever made."""
    g = cut(df.groupBy(F.col(duration).cast("double").alias("t"), F.col(risk).cast("double").alias("r"), F.col(event).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).where("t is not null and r is not null"), "risks")
    failed = F.when(F.col("e") == 1, F.col("n")).otherwise(F.lit(0))
    # a row beats those of longer durations and smaller risks
    won = _won(_ranked(g.withColumn("low", -F.col("r")), "low").select(F.lit(0).alias("g"), "k", (-F.col("t")).alias("pos"), F.col("n").alias("held"), failed.alias("asked")))
    times = g.groupBy("t").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(failed.cast("decimal(38,0)")).alias("failed"))
    longer = running(times, [F.desc("t")], {"upto": F.col("n")})
    pairs = longer.agg(F.coalesce(F.sum(F.col("failed") * (F.col("upto") - F.col("n"))), F.lit(0).cast("decimal(38,0)")).cast("long").alias("pairs"))
    return won.crossJoin(F.broadcast(pairs)).select(F.coalesce(F.try_divide("won", F.col("pairs").cast("double")), F.lit(0.5)).alias("concordance_index"), "pairs")


def time_dependent_concordance(curve: DataFrame, truth: DataFrame, key: str, duration: str = "duration", event: str = "event") -> DataFrame:
    """concordance_td, pairs: each failure's curve against the curves of all that lived longer, at the failure's own time.

    ``curve`` is key, t, survival on one grid of times; a duration is read at the last time up to it (the first if none is). Of rows of the
    same duration a failure is compared with a censored one like with a longer one, two failures are concordant if their curves agree and
    half so if not; such pairs count in both directions. Rows without a duration, or whose key has no curve, are left out; without a pair the
    index is 0.5. A cell of the grid holds the rows that live to see it, grouped by survival and duration; no pair is made.
    """
    own = truth.select(key, F.col(duration).cast("double").alias("t"), F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("e")).where("t is not null")
    steps = curve.select(key, F.col("t").cast("double").alias("at"), F.col("survival").cast("double").alias("s")).where("at is not null and s is not null")
    marks = steps.select(F.col("at").alias("t"), F.lit(1).cast("long").alias("mark")).distinct().unionByName(own.select("t", F.lit(0).cast("long").alias("mark")).distinct())
    marks = marks.groupBy("t").agg(F.max("mark").alias("mark"))
    cells = cut(running(marks, [F.col("t")], {"cell": F.col("mark")}).withColumn("cell", F.greatest("cell", F.lit(1))), "cells")
    own = own.join(cells.select("t", "cell"), "t")
    asking = own.where("e = 1").select("cell").distinct()
    steps = steps.join(cells.where("mark = 1").select(F.col("t").alias("at"), F.col("cell").alias("g")), "at").join(asking.withColumnRenamed("cell", "g"), "g", "left_semi")
    # every row once at its own cell, and at the earlier ones in which a row fails
    seen = steps.join(own, key).where("g <= cell").groupBy("g", "s", "t", "e", "cell").agg(F.count(F.lit(1)).alias("n"))
    seen = cut(_ranked(seen, "s").withColumn("own", F.col("g") == F.col("cell")), "seen")
    failed = F.when(F.col("own") & (F.col("e") == 1), F.col("n")).otherwise(F.lit(0))
    later = _won(seen.select("g", "k", (-F.col("t")).alias("pos"), F.col("n").alias("held"), failed.alias("asked"))).withColumnRenamed("won", "later")
    # of one duration: the censored ones come first, so every failure sees them
    censored = F.when(F.col("e") != 1, F.col("n")).otherwise(F.lit(0))
    tied = _won(seen.where("own").select(F.col("t").alias("g"), "k", F.when(F.col("e") == 1, 1).otherwise(0).alias("pos"), censored.alias("held"), failed.alias("asked"))).withColumnRenamed("won", "tied")
    twice = lambda c: F.col(c) * (F.col(c) - 1)
    alike = seen.where("own and e = 1").groupBy("t", "s").agg(F.sum(F.col("n").cast("double")).alias("m")).agg(F.coalesce(F.sum(twice("m")), F.lit(0.0)).alias("alike"))
    # who is compared at all: rows with a curve
    held = own.join(steps.select(key).distinct(), key, "left_semi")
    times = held.groupBy("t").agg(F.sum(F.lit(1).cast("decimal(38,0)")).alias("n"), F.sum(F.col("e").cast("decimal(38,0)")).alias("d"))
    counts = running(times, [F.desc("t")], {"upto": F.col("n")})
    none = F.lit(0).cast("decimal(38,0)")
    counts = counts.agg(F.coalesce(F.sum(F.col("d") * (F.col("upto") - F.col("n")) + twice("d") + 2 * F.col("d") * (F.col("n") - F.col("d"))), none).cast("long").alias("pairs"), F.coalesce(F.sum(twice("d")), none).cast("double").alias("both"))
    one = later.crossJoin(F.broadcast(tied)).crossJoin(F.broadcast(alike)).crossJoin(F.broadcast(counts))
    won = F.col("later") + 2 * F.col("tied") + 0.5 * F.col("both") + 0.5 * F.col("alike")
    return one.select(F.coalesce(F.try_divide(won, F.col("pairs").cast("double")), F.lit(0.5)).alias("concordance_td"), "pairs")


def evaluate_survival(curve: DataFrame, truth: DataFrame, key: str, duration: str = "duration", event: str = "event") -> DataFrame:
    """Concordance of minus the median survival time, its time-dependent form, and the median's mean absolute error over all rows."""
    median = quantile_time(curve, 0.5, (key,)).withColumnRenamed("time", "median")
    rows = truth.join(median, key).withColumn("risk_score", -F.col("median"))
    error = rows.agg(F.avg(F.abs(F.col("median") - F.col(duration))).alias("mae"))
    timed = time_dependent_concordance(curve, truth, key, duration, event).select("concordance_td")
    return concordance(rows, duration, "risk_score", event).crossJoin(F.broadcast(error)).crossJoin(F.broadcast(timed))


def health_from_survival(curve: DataFrame, key: str, probability: float = 0.5, healthy: float = 30, warning: float = 10) -> DataFrame:
    """key, rul (time to failure), health_state."""
    out = time_to_failure(curve, (key,), probability).withColumnRenamed("time", "rul")
    return out.withColumn("health_state", health_from_rul(F.col("rul"), healthy, warning))


def compare_models(kinds: list[str], train: DataFrame, test: DataFrame, key: str, features: list[str]) -> DataFrame:
    """One row for each kind of model: concordance, error, and the text of a failure."""
    out = []
    for kind in kinds:
        try:
            r = evaluate_survival(survival_model(kind, features).fit(train).curve(test, key), test, key).first()
            out.append((kind, r.concordance_index, r.mae, None))
        except Exception as e:  # one model's failure is a row of the comparison
            out.append((kind, None, None, str(e)))
    return train.sparkSession.createDataFrame(out, "model string, concordance_index double, mae double, error string")
