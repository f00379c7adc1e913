"""Failure risk, remaining useful life and ordinal health states on top of pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.rules import fused_risk, health_from_probability, min_max
from tidewatch.operators.detectors import IsolationForest, by_matrix, matrix, moments
from tidewatch.operators.scoring import NotFitted
from tidewatch.sources.scratch import cut


def _with_vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with a vector beside each feature that is an array; rows without one are skipped."""
    types = dict(df.dtypes)
    for c in features:
        if types[c].startswith("array"):
            df = df.where(F.col(c).isNotNull()).withColumn(f"_v_{c}", array_to_vector(F.col(c).cast("array<double>")))
    return df


def _inputs(df: DataFrame, features: list[str]) -> list[str]:
    return [f"_v_{c}" if f"_v_{c}" in df.columns else c for c in features]


def _prepared(features: list[str], scale: bool = True) -> list:
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip")]
    return [*stages, StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)] if scale else stages


@dataclass
class FailureRisk:
    """A random forest on scaled features; ``transform`` adds failure_probability, failure_prediction and health_state."""

    features: list[str] = field(default_factory=list)
    label: str = "label"
    n_estimators: int = 100
    max_depth: int = 8
    risk: float = 0.5
    distress: float = 0.8
    seed: int = 0
    model: object = field(default=None, init=False)

    def fit(self, df: DataFrame) -> FailureRisk:
        df = _with_vectors(df, self.features).withColumn("_y", (F.col(self.label) > 0).cast("double"))
        self.single = df.agg(F.count_distinct("_y")).first()[0] < 2
        forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=self.n_estimators, maxDepth=self.max_depth, seed=self.seed, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")
        self.model = Pipeline(stages=[*_prepared(_inputs(df, self.features)), forest]).fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("FailureRisk is not fitted")
        p = vector_to_array("_p")
        out = self.model.transform(_with_vectors(df, self.features)).withColumn("failure_probability", F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)))
        out = out.withColumn("failure_prediction", F.col("_c").cast("int")).withColumn("health_state", health_from_probability(F.col("failure_probability"), self.risk, self.distress))
        return out.drop("_raw", "_x", "_p", "_r", "_c", *[f"_v_{c}" for c in self.features])


@dataclass
class SequenceClassifier:
    """Distress from the flattened sequence of sensor rows (``operators.windows.sequences``): a forest or a small network."""

    network: bool = False
    n_estimators: int = 100
    hidden: int = 32
    seed: int = 0
    model: object = field(default=None, init=False)

    def fit(self, rows: DataFrame) -> SequenceClassifier:
        x = rows.withColumn("_x", array_to_vector(F.flatten("sequence"))).withColumn("_y", (F.col("label") > 0).cast("double"))
        shape = {"featuresCol": "_x", "labelCol": "_y", "seed": self.seed, "probabilityCol": "_p", "rawPredictionCol": "_r", "predictionCol": "_c"}
        if self.network:
            size = rows.select(F.size(F.flatten("sequence"))).first()[0]
            made = MultilayerPerceptronClassifier(layers=[size, self.hidden, 2], maxIter=60, **shape)
        else:
            made = RandomForestClassifier(numTrees=self.n_estimators, **shape)
        self.model = Pipeline(stages=[made]).fit(x)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("SequenceClassifier is not fitted")
        x = self.model.transform(rows.withColumn("_x", array_to_vector(F.flatten("sequence"))))
        x = x.withColumn("distress_probability", vector_to_array("_p")[1])
        return x.withColumn("health_state", health_from_probability(F.col("distress_probability"))).drop("_x", "_p", "_r", "_c")


@dataclass
class RULEstimator:
    """A regression forest; predictions are not negative. With a degradation threshold the target is what is left to it."""

    features: list[str] = field(default_factory=list)
    label: str = "RUL"
    n_estimators: int = 50
    max_depth: int = 8
    degradation_threshold: float | None = None
    seed: int = 0
    model: object = field(default=None, init=False)

    def fit(self, df: DataFrame) -> RULEstimator:
        y = F.col(self.label).cast("double")
        if self.degradation_threshold is not None:
            y = F.greatest(F.lit(float(self.degradation_threshold)) - y, F.lit(0.0))
        forest = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=self.n_estimators, maxDepth=self.max_depth, seed=self.seed, predictionCol="_c")
        self.model = Pipeline(stages=[*_prepared(self.features), forest]).fit(df.withColumn("_y", y))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("RULEstimator is not fitted")
        return self.model.transform(df).withColumn("rul", F.greatest("_c", F.lit(0.0))).drop("_raw", "_x", "_c")


#: Class probabilities that stand for each predicted ordinal state (fixed values).
ORDINAL_TEMPLATE = ((0.7, 0.2, 0.1), (0.2, 0.6, 0.2), (0.1, 0.2, 0.7))


@dataclass
class OrdinalClassifier:
    """States 0, 1, 2 by chained logistic regressions (``cumulative``: y > k; ``conditional``: y > k of those over k - 1)."""

    features: list[str] = field(default_factory=list)
    label: str = "health_state"
    kind: str = "cumulative"
    penalty: float = 1e-3
    models: list = field(default_factory=list, init=False)

    def fit(self, df: DataFrame) -> OrdinalClassifier:
        if not df.where(~F.coalesce(F.col(self.label).isin(0, 1, 2), F.lit(False))).isEmpty():
            raise ValueError("states must be 0, 1 or 2")
        self.models = []
        for k in (0, 1):
            own = _with_vectors(df.where(F.col(self.label) >= k) if self.kind == "conditional" else df, self.features)
            step = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=self.penalty, probabilityCol=f"_p{k}", rawPredictionCol=f"_r{k}", predictionCol=f"_c{k}")
            self.models.append(Pipeline(stages=[*_prepared(_inputs(own, self.features)), step]).fit(own.withColumn("_y", (F.col(self.label) > k).cast("double"))))
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if not self.models:
            raise NotFitted("OrdinalClassifier is not fitted")
        kept = df.columns
        df = _with_vectors(df, self.features)
        for m in self.models:
            df = m.transform(df).drop("_raw", "_x")
        p0, p1 = F.get(vector_to_array("_p0"), F.lit(1)), F.get(vector_to_array("_p1"), F.lit(1))
        over = p0 * p1 if self.kind == "conditional" else F.least(p0, p1)
        state = (p0 > 0.5).cast("int") + (over > 0.5).cast("int")
        return df.select(*kept, state.alias(out), F.array(1 - p0, p0 - over, over).alias("probabilities"), template(state).alias("template_probabilities"))


def template(state: Column) -> Column:
    rows = [F.array(*[F.lit(p) for p in row]) for row in ORDINAL_TEMPLATE]
    return F.when(state == 0, rows[0]).when(state == 1, rows[1]).otherwise(rows[2])


@dataclass
class ProportionalOdds:
    """States 0 to ``classes - 1`` by one slope and ordered cuts: P(state <= k) is the logistic function of cut k minus the slope.

    Newton steps on the likelihood with a ridge on the slope (of standardised features), from sums over the table: each
    task adds gradient and curvature of its rows, and as many numbers as the curvature has come to the driver. A step that
    would not raise the likelihood or would cross the cuts is halved. Rows with a missing feature are left out and get null.
    """

    features: list[str] = field(default_factory=list)
    label: str = "health_state"
    classes: int = 3
    penalty: float = 1.0
    steps: int = 50
    fitted: dict = field(default_factory=dict, init=False)

    def _sums(self, rows: DataFrame, cuts: np.ndarray, slope: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised log-likelihood, gradient and curvature at cuts and slope."""
        names, label, m, d = list(self.features), rows.columns[-1], len(cuts), len(slope)

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((m + d + 1, m + d + 1))
            for part in parts:
                if len(part):
                    total += ordinal_sums((matrix(part, names) - mean) / std, part[label].to_numpy(int), cuts, slope)
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

        total = np.zeros((m + d + 1, m + d + 1))
        for r in rows.mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            total[r.i, r.j] = r.s
        ridge = np.concatenate([np.zeros(m), np.full(d, self.penalty)])
        place = np.concatenate([cuts, slope])
        return total[0, 0] - (ridge * place * place).sum() / 2, total[0, 1:] - ridge * place, total[1:, 1:] - np.diag(ridge)

    def fit(self, df: DataFrame) -> ProportionalOdds:
        label = F.col(self.label)
        if not df.where(~F.coalesce(label.between(0, self.classes - 1), F.lit(False))).isEmpty():
            raise ValueError(f"states must be 0 to {self.classes - 1}")
        kept = "_y" if self.label in self.features else self.label
        own = df.select(*self.features, label.cast("int").alias(kept))
        for c in self.features:
            own = own.where(F.col(c).isNotNull() & ~(F.exists(c, lambda v: v.isNull() | F.isnan(v)) if dict(df.dtypes)[c].startswith("array") else F.isnan(F.col(c).cast("double"))))
        own = cut(own, "states")
        n, mean, cov = moments(own, list(self.features))
        if not n:
            raise ValueError("nothing to learn from")
        std = np.sqrt(np.diag(cov))
        std[std < 1e-12] = 1.0
        counts = {r[kept]: r["count"] for r in own.groupBy(kept).count().collect()}  # a row a state
        share = np.cumsum([counts.get(k, 0) + 0.5 for k in range(self.classes)])[:-1] / (n + self.classes / 2)
        cuts, slope = np.log(share / (1 - share)), np.zeros(len(mean))
        value, gradient, curve = self._sums(own, cuts, slope, mean, std)
        for _ in range(self.steps):
            step = np.linalg.solve(curve - 1e-9 * np.eye(len(curve)), -gradient)
            for halved in range(30):
                place = np.concatenate([cuts, slope]) + step / 2**halved
                if (np.diff(place[: len(cuts)]) > 0).all():
                    new = self._sums(own, place[: len(cuts)], place[len(cuts) :], mean, std)
                    if new[0] >= value - 1e-12 * abs(value):
                        break
            else:
                break
            cuts, slope, (value, gradient, curve) = place[: len(cuts)], place[len(cuts) :], new
            if np.abs(step).max() < 1e-8:
                break
        self.fitted = {"cuts": cuts.tolist(), "slope": slope.tolist(), "mean": mean.tolist(), "std": std.tolist()}
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the likeliest state, P(each state) and the template's probabilities."""
        if not self.fitted:
            raise NotFitted("ProportionalOdds is not fitted")
        slope, mean, std = (np.array(self.fitted[k]) for k in ("slope", "mean", "std"))
        level = by_matrix(list(self.features), lambda x: (x - mean) / std @ slope)
        df = df.withColumn("_level", level)
        upto = [F.lit(0.0), *[1 / (1 + F.exp(F.col("_level") - c)) for c in self.fitted["cuts"]], F.lit(1.0)]
        each = F.array(*[b - a for a, b in zip(upto, upto[1:], strict=False)])
        state = F.when(F.col("_level").isNotNull(), (F.array_position(each, F.array_max(each)) - 1).cast("int"))
        df = df.withColumn("probabilities", F.when(F.col("_level").isNotNull(), each)).withColumn(out, state)
        return df.withColumn("template_probabilities", F.when(F.col(out).isNotNull(), template(F.col(out)))).drop("_level")


def ordinal_sums(x: np.ndarray, y: np.ndarray, cuts: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Log-likelihood (first cell), gradient (rest of the first row) and curvature of ordered logistic states."""
    m, level, n = len(cuts), x @ slope, np.arange(len(y))
    ends = np.concatenate([[-np.inf], cuts, [np.inf]])
    high, low = ends[y + 1] - level, ends[y] - level
    fa, fb = 1 / (1 + np.exp(-np.clip(high, -700, 700))), 1 / (1 + np.exp(-np.clip(low, -700, 700)))
    fa[y == m], fb[y == 0] = 1.0, 0.0
    p = np.maximum(fa - fb, 1e-300)
    da, db = fa * (1 - fa), fb * (1 - fb)
    za, zb = np.zeros((len(y), m + len(slope))), np.zeros((len(y), m + len(slope)))
    za[:, m:] = zb[:, m:] = -x
    za[n[y < m], y[y < m]] = 1.0
    zb[n[y > 0], y[y > 0] - 1] = 1.0
    ga, gb = da / p, -db / p
    cross = (za * (da * db / (p * p))[:, None]).T @ zb
    out = np.zeros((m + len(slope) + 1,) * 2)
    out[0, 0] = np.log(p).sum()
    out[0, 1:] = ga @ za + gb @ zb
    out[1:, 1:] = (za * (da * (1 - 2 * fa) / p - ga * ga)[:, None]).T @ za + (zb * (-db * (1 - 2 * fb) / p - gb * gb)[:, None]).T @ zb + cross + cross.T
    return out


@dataclass
class BoostedOrdinal:
    """Boosted trees with absolute loss on the state number, rounded half to even and clipped."""

    features: list[str] = field(default_factory=list)
    label: str = "health_state"
    iterations: int = 100
    seed: int = 0
    model: object = field(default=None, init=False)

    def fit(self, df: DataFrame) -> BoostedOrdinal:
        trees = GBTRegressor(featuresCol="_raw", labelCol=self.label, lossType="absolute", maxIter=self.iterations, seed=self.seed, predictionCol="_c")
        df = _with_vectors(df, self.features)
        self.model = Pipeline(stages=[*_prepared(_inputs(df, self.features), scale=False), trees]).fit(df)
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.model is None:
            raise NotFitted("BoostedOrdinal is not fitted")
        df = self.model.transform(_with_vectors(df, self.features))
        e = [F.exp(-F.abs(F.col("_c") - k)) for k in range(3)]
        return df.withColumn("probabilities", F.array(*[x / (e[0] + e[1] + e[2]) for x in e])).withColumn(out, rounded_state(F.col("_c"))).drop("_raw", "_c", *[f"_v_{c}" for c in self.features])


def rounded_state(x: Column) -> Column:
    return F.greatest(F.least(F.bround(x), F.lit(2.0)), F.lit(0.0)).cast("int")


def averaged(df: DataFrame, models: list, out: str = "prediction") -> DataFrame:
    """The mean of several ordinal models' states, rounded."""
    if not models:
        raise ValueError("no models")
    names = [f"_m{i}" for i in range(len(models))]
    kept = df.columns
    for name, m in zip(names, models, strict=True):
        df = m.transform(df, name).select(*kept, *names[: names.index(name)], name)
    return df.withColumn(out, rounded_state(sum((F.col(n) for n in names), F.lit(0.0)) / len(names))).drop(*names)


@dataclass
class StackedOrdinal:
    """A multinomial logistic regression on the base models' states."""

    models: list = field(default_factory=list)
    label: str = "health_state"
    meta: object = field(default=None, init=False)

    def _bases(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        names, kept = [f"_m{i}" for i in range(len(self.models))], df.columns
        for i, m in enumerate(self.models):
            df = m.transform(df, names[i]).select(*kept, *names[: i + 1])
        return df, names

    def fit(self, df: DataFrame) -> StackedOrdinal:
        for m in self.models:
            m.fit(df)
        rows, names = self._bases(df)
        top = LogisticRegression(featuresCol="_raw", labelCol=self.label, family="multinomial", regParam=1e-3, predictionCol="_c", probabilityCol="_p", rawPredictionCol="_r")
        self.meta = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"), top]).fit(rows)
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.meta is None:
            raise NotFitted("StackedOrdinal is not fitted")
        rows, names = self._bases(df)
        return self.meta.transform(rows).withColumn(out, F.col("_c").cast("int")).drop("_raw", "_c", "_p", "_r", *names)


def assess_assets(df: DataFrame, key: str, features: list[str], label: str | None = None, contamination: float = 0.05, failure_weight: float = 0.6, anomaly_weight: float = 0.4, seed: int = 0) -> DataFrame:
    """key, failure_risk, health_state, is_anomaly, anomaly_score, combined_risk, highest risk first."""
    scored = IsolationForest(tuple(features), contamination, seed=seed).fit(df).transform(df)
    scored = min_max(scored.withColumnRenamed("score", "anomaly_score"), "anomaly_score", "_scaled")
    if label:
        scored = FailureRisk(features, label, seed=seed).fit(df).transform(scored)
        risk, state = F.col("failure_probability"), F.col("health_state")
        total = fused_risk(risk, F.col("_scaled"), failure_weight, anomaly_weight)
    else:
        risk, state, total = F.lit(None).cast("double"), F.lit(None).cast("int"), F.col("_scaled")
    out = scored.select(key, risk.alias("failure_risk"), state.alias("health_state"), F.col("flag").alias("is_anomaly"), "anomaly_score", total.alias("combined_risk"))
    return out.orderBy(F.desc("combined_risk"), key)
