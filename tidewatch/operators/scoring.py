"""Scorers, metrics and monitoring: aggregates, exact quantiles and joins only.

A scorer makes a ``score`` column (higher: more anomalous); a threshold rule makes a 0/1 flag of it. Fitted
scorers hold a few numbers and are plain column expressions afterwards.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.rules import ThresholdRule, apply_threshold, no_nan, seasonal_key
from tidewatch.operators.ordering import quantile, quantiles, running


def robust_z(df: DataFrame, value: str, partition: tuple[str, ...] = (), out: str = "score", absolute: bool = True, epsilon: float = 1e-8) -> DataFrame:
    """Deviation from the median by the median absolute deviation, of each entity or the whole batch."""
    x = no_nan(value)
    if partition:
        w = Window.partitionBy(*partition)
        df = df.withColumn("_med", F.percentile(x, 0.5).over(w)).withColumn("_mad", F.percentile(F.abs(x - F.col("_med")), 0.5).over(w))
    else:
        df = df.withColumn("_med", F.lit(quantile(df, x, 0.5)).cast("double"))
        df = df.withColumn("_mad", F.lit(quantile(df, F.abs(x - F.col("_med")), 0.5)).cast("double"))
    z = (x - F.col("_med")) / (F.col("_mad") + epsilon)
    return df.withColumn(out, F.abs(z) if absolute else z).drop("_med", "_mad")


class NotFitted(ValueError):
    """A scorer or detector is used before ``fit``."""


@dataclass
class Scorer:
    """Extension point: ``fit`` learns from a DataFrame, ``transform`` adds ``score``. Parameters are the fields."""

    fitted: dict = field(default_factory=dict, init=False)

    def fit(self, df: DataFrame) -> Scorer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def params(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "fitted"}

    def with_params(self, **changed) -> Scorer:
        """A copy, with its fitted state, and other parameters."""
        import copy

        other = copy.deepcopy(self)
        for k, v in changed.items():
            if k not in self.params():
                raise ValueError(f"no parameter {k!r}")
            setattr(other, k, v)
        return other

    def need_fit(self) -> None:
        if not self.fitted:
            raise NotFitted(f"{type(self).__name__} is not fitted")

    def tags(self) -> dict[str, bool]:
        """What the object needs and makes."""
        return {"detector": isinstance(self, Detector), "fit": type(self).fit is not Scorer.fit, "univariate": "value" in self.params()}

    def to_json(self) -> str:
        return json.dumps({"class": type(self).__name__, "params": self.params(), "fitted": self.fitted})


class Detector(Scorer):
    """Extension point: ``transform`` adds ``score`` and the detector's own 0/1 ``flag``."""


@dataclass
class RobustZScore(Scorer):
    value: str = "value"
    partition: tuple[str, ...] = ()
    epsilon: float = 1e-8

    def transform(self, df: DataFrame) -> DataFrame:
        return robust_z(df, self.value, tuple(self.partition), epsilon=self.epsilon)


@dataclass
class ZScore(Scorer):
    """The largest absolute z-score over the features; the deviation is the population's, 1 if it is 0."""

    features: tuple[str, ...] = ("value",)

    def fit(self, df: DataFrame) -> ZScore:
        r = df.agg(*[f(no_nan(c)).alias(f"{n}_{c}") for c in self.features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.fitted = {c: [r[f"m_{c}"], r[f"s_{c}"] or 1.0] for c in self.features}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.need_fit()
        z = [F.abs((no_nan(c) - m) / s) for c, (m, s) in self.fitted.items()]
        return df.withColumn("score", F.greatest(*z) if len(z) > 1 else z[0])


@dataclass
class InterquartileRange(Scorer):
    """How far outside the fences a row lies, in units of the largest range; 0 inside."""

    features: tuple[str, ...] = ("value",)
    factor: float = 1.5

    def fit(self, df: DataFrame) -> InterquartileRange:
        found = quantiles(df, {c: (no_nan(c), [0.25, 0.75]) for c in self.features})
        self.fitted = {c: [q1, q3, (q3 - q1) or 1.0] for c, (q1, q3) in found.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.need_fit()
        out = []
        for c, (q1, q3, iqr) in self.fitted.items():
            x = no_nan(c)
            out.append(F.greatest(q1 - self.factor * iqr - x, x - q3 - self.factor * iqr, F.lit(0.0)))
        scale = max(v[2] for v in self.fitted.values()) + 1e-10
        return df.withColumn("score", (F.greatest(*out) if len(out) > 1 else out[0]) / scale)


def seasonal_score(train: DataFrame, df: DataFrame, ts: str, value: str, seasonality: str = "week", entity: tuple[str, ...] = ()) -> DataFrame:
    """Deviation from the mean of the same season (of the entity) in sample deviations; 0 for unseen seasons."""
    keys = [*entity, "_season"]
    stats = train.withColumn("_season", seasonal_key(F.col(ts), seasonality)).groupBy(*keys).agg(F.avg(no_nan(value)).alias("_mean"), F.stddev_samp(no_nan(value)).alias("_std"))
    df = df.withColumn("_season", seasonal_key(F.col(ts), seasonality)).join(stats, keys, "left")
    unit = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return df.withColumn("score", F.coalesce(F.abs(no_nan(value) - F.col("_mean")) / unit, F.lit(0.0))).drop("_season", "_mean", "_std")


def score_anomalies(df: DataFrame, scorer: Scorer) -> DataFrame:
    """``df`` with ``score``."""
    return scorer.transform(df)


def detect_anomalies(df: DataFrame, scorer: Scorer, rule: ThresholdRule | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """score and flag: a detector's own flag, or the scorer's score under the rule."""
    out = scorer.transform(df)
    if isinstance(scorer, Detector):
        return out
    if rule is None:
        raise ValueError("a scorer needs a threshold rule")
    return apply_threshold(out, rule, partition=partition)


def confusion(predicted: Column, truth: Column) -> dict[str, Column]:
    p, t = predicted == 1, truth == 1
    return {"tp": F.count_if(p & t), "fp": F.count_if(p & ~t), "tn": F.count_if(~p & ~t), "fn": F.count_if(~p & t)}


def _rates(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    df = df.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return df.withColumn("f1", f1)


def detection_metrics(df: DataFrame, predicted: str = "flag", truth: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1 of each group; ratios without cases are 0."""
    counts = df.groupBy(*by).agg(*[c.alias(k) for k, c in confusion(F.col(predicted), F.col(truth)).items()])
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return _rates(counts).withColumn("accuracy", F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), total), F.lit(0.0)))


def average_run_length(df: DataFrame, predicted: str, at: str, by: tuple[str, ...] = ()) -> DataFrame:
    """avg_run_length of the runs of 1 of each group, 0 without any; ``at`` counts a group's rows without gaps.

    A run starts at a 1 that no 1 precedes: each row is joined to the one before, so no task sees a whole series.
    """
    own = df.where(F.col(predicted) == 1).select(*by, F.col(at).cast("long").alias("_at"))
    before = own.select(*by, (F.col("_at") + 1).alias("_at"), F.lit(1).alias("_goes_on"))
    runs = own.join(before, [*by, "_at"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_goes_on").isNull()).alias("_runs"))
    length = F.coalesce(F.try_divide(F.col("_n").cast("double"), F.col("_runs")), F.lit(0.0)).alias("avg_run_length")
    if not by:
        return runs.select(length)
    return df.select(*by).distinct().join(runs, list(by), "left").select(*by, length)


def performance_metrics(df: DataFrame, score: str = "score", predicted: str = "flag", truth: str = "label", order: tuple[str, ...] = ()) -> DataFrame:
    """Rates, the share of flags, and mean, maximum, minimum and deviation of the scores, in one row; with an order, the mean length of runs of flags."""
    counts = df.agg(*[c.alias(k) for k, c in confusion(F.col(predicted), F.col(truth)).items()], F.avg(predicted).alias("anomaly_rate"), F.avg(score).alias("score_mean"), F.max(score).alias("score_max"), F.min(score).alias("score_min"), F.stddev_pop(score).alias("score_std"))
    if order:
        numbered = running(df.select(predicted, *order), [F.col(c) for c in order], {"_n": F.lit(1)})
        counts = counts.crossJoin(F.broadcast(average_run_length(numbered, predicted, "_n")))  # one row
    return _rates(counts)


def roc_auc(df: DataFrame, score: str = "score", truth: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area by ranks with ties at their mean; 0 without both classes. Ranks come from counts of distinct scores."""
    each = df.groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    if by:
        each = each.withColumn("_upto", F.sum("neg").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        each = running(each, [F.col(score)], {"_upto": F.col("neg")})
    each = each.withColumn("_won", F.col("pos") * (F.col("_upto") - F.col("neg") / 2))
    return each.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("_won"), (F.sum("pos") * F.sum("neg")).cast("double")), F.lit(0.0)).alias("roc_auc"))


def evaluate_detector(df: DataFrame, scorer: Scorer, rule: ThresholdRule | None = None, truth: str = "label", at: str | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts, accuracy, precision, recall, f1, roc_auc, and with a time column the lead times of detections."""
    from tidewatch.operators.windows import lead_times

    out = detect_anomalies(df, scorer, rule, partition)
    row = detection_metrics(out, truth=truth).crossJoin(F.broadcast(roc_auc(out, truth=truth)))
    if at:
        leads = lead_times(out, "flag", truth, at, list(partition))
        total = [F.avg("mean_lead").alias("mean_lead"), F.min("min_lead").alias("min_lead"), F.max("max_lead").alias("max_lead"), F.coalesce(F.sum("early"), F.lit(0)).alias("early"), F.coalesce(F.sum("late"), F.lit(0)).alias("late")]
        row = row.crossJoin(F.broadcast(leads.agg(*total)))
    return row


def compare_detectors(df: DataFrame, scorers: dict[str, Scorer], rule: ThresholdRule | None = None, truth: str = "label", at: str | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """``evaluate_detector`` of each, in one table: detector and its metrics."""
    if not scorers:
        raise ValueError("no detectors")
    out = None
    for name, s in scorers.items():
        row = evaluate_detector(df, s, rule, truth, at, partition).select(F.lit(name).alias("detector"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def comparison_metrics(compared: DataFrame, metrics: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """The data of a comparison chart: detector, metric, value; ValueError if none of the metrics is there."""
    found = [m for m in metrics if m in compared.columns]
    if not found:
        raise ValueError(f"none of {metrics} is a column")
    return compared.select("detector", *[F.col(m).cast("double").alias(m) for m in found]).unpivot(["detector"], found, "metric", "value")


def sweep_thresholds(df: DataFrame, thresholds: list[float], score: str = "score", truth: str = "label") -> DataFrame:
    """Precision, recall and f1 at each threshold: one pass over the scores, a sum for each threshold."""
    rows = df.select(no_nan(score).alias("s"), (F.col(truth) != 0).cast("int").alias("t"))
    sums = [F.struct(F.lit(float(x)).alias("threshold"), F.count_if((F.col("s") >= x) & (F.col("t") == 1)).alias("tp"), F.count_if((F.col("s") >= x) & (F.col("t") == 0)).alias("fp"), F.count_if(~F.coalesce(F.col("s") >= x, F.lit(False)) & (F.col("t") == 1)).alias("fn")) for x in thresholds]
    return _rates(rows.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")).drop("tp", "fp", "fn")


def report_detection(df: DataFrame, at: str, top: int = 10) -> DataFrame:
    """Counts, score statistics, and the ``top`` flagged times by score, in one row."""
    stats = df.agg(F.count_if(F.col("flag") == 1).alias("n_anomalies"), F.count(F.lit(1)).alias("n_total"), F.avg("flag").alias("anomaly_rate"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))
    best = df.where("flag = 1").orderBy(F.desc("score"), at).limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(at).alias("t")))).alias("b"))
    return stats.crossJoin(best.select(F.transform("b", lambda x: x["t"]).alias("top_anomalies")))


def concept_drift(recent: DataFrame, history: DataFrame, value: str, threshold: float = 2.0) -> DataFrame:
    """Shift of the mean in historical deviations, whether it exceeds the threshold, and the two-sample KS distance."""
    both = recent.select(no_nan(value).alias("x"), F.lit(1).alias("r")).unionByName(history.select(no_nan(value).alias("x"), F.lit(0).alias("r"))).where("x is not null")
    a = both.agg(F.avg(F.when(F.col("r") == 1, F.col("x"))).alias("recent_mean"), F.avg(F.when(F.col("r") == 0, F.col("x"))).alias("historical_mean"), F.stddev_pop(F.when(F.col("r") == 0, F.col("x"))).alias("historical_std"), F.count_if(F.col("r") == 1).alias("n1"), F.count_if(F.col("r") == 0).alias("n0"))
    steps = both.groupBy("x").agg(F.count_if(F.col("r") == 1).alias("k1"), F.count_if(F.col("r") == 0).alias("k0"))
    steps = running(steps, [F.col("x")], {"c1": F.col("k1"), "c0": F.col("k0")})
    gap = steps.crossJoin(F.broadcast(a.select("n1", "n0"))).agg(F.max(F.abs(F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0"))).alias("ks_statistic"))
    drift = F.when(F.col("historical_std") > 0, F.abs(F.col("recent_mean") - F.col("historical_mean")) / F.col("historical_std")).otherwise(0.0)
    out = a.crossJoin(F.broadcast(gap)).withColumn("drift_score", drift).withColumn("drift_detected", (F.col("drift_score") > threshold).cast("int"))
    # The asymptotic distribution of the KS distance, as an alternating series.
    t = F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))) * F.col("ks_statistic")
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2 * k * k * t * t) for k in range(1, 101)), F.lit(0.0))
    return out.withColumn("ks_pvalue", F.when(t < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))))


def metric_rows(metrics: DataFrame, model: str | None = None, at: str | None = None) -> DataFrame:
    """A monitoring payload: one row for each metric's mean, and its minimum and maximum where it has several values."""
    names = [c for c, t in metrics.dtypes if c != at and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    long = metrics.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "MetricName", "Value").where("Value is not null")
    stats = long.groupBy("MetricName").agg(F.avg("Value").alias("m"), F.min("Value").alias("lo"), F.max("Value").alias("hi"), F.count(F.lit(1)).alias("n"))
    each = F.array(F.struct(F.lit("").alias("s"), F.col("m").alias("v")), F.struct(F.lit("_Min").alias("s"), F.col("lo").alias("v")), F.struct(F.lit("_Max").alias("s"), F.col("hi").alias("v")))
    rows = stats.select("MetricName", "n", F.explode(each).alias("e")).where("e.s = '' or n > 1")
    return rows.select(F.concat("MetricName", "e.s").alias("MetricName"), F.col("e.v").alias("Value"), F.lit("None").alias("Unit"), F.lit(model).alias("ModelName"))


def backtest(df: DataFrame, value: str, order: list[str], rule: ThresholdRule, truth: str = "label", n_splits: int = 5, min_train: int = 10) -> DataFrame:
    """Folds of growing training windows under a z-score fitted in each, all in one job: fold, precision, recall, f1, avg_run_length.

    The test window runs from the fold's cutoff to the end of the series.
    """
    from tidewatch.operators.windows import expanding_folds

    spark = df.sparkSession
    numbered = running(df, [F.col(c) for c in order], {"_n": F.lit(1)}).withColumn("_at", F.col("_n") - 1).drop("_n")
    folds = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(expanding_folds(df.count(), n_splits, min_train))], "fold int, train_end long, test_start long")
    rows = numbered.join(F.broadcast(folds))  # as many copies of a row as folds
    x = no_nan(value)
    train = rows.where("_at < train_end").groupBy("fold").agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    test = rows.where("_at >= test_start").join(F.broadcast(train), "fold")
    test = test.withColumn("score", F.abs(x - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    flagged = apply_threshold(test, rule, partition=("fold",))
    flagged = flagged.withColumn(truth, (F.coalesce(F.col(truth), F.lit(0)) != 0).cast("int"))
    metrics = detection_metrics(flagged, truth=truth, by=("fold",)).select("fold", "precision", "recall", "f1")
    return metrics.join(F.broadcast(average_run_length(flagged, "flag", "_at", ("fold",))), "fold")  # a row a fold


def rank_by_risk(df: DataFrame, key: str, risk: str = "combined_risk", top: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(risk), key)
    return out.limit(top) if top else out


def score_view(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys and score; ValueError if a key repeats or is missing, or the score is no number."""
    if dict(df.dtypes)[score] not in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        raise ValueError(f"{score} must be a number")
    _assert_keys(df, keys)
    return df.select(*keys, F.col(score).cast("double").alias("score"))


def label_view(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """keys and label; ValueError if a key repeats or is missing, or a label is neither 0 nor 1."""
    if not df.where(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).isEmpty():
        raise ValueError("labels must be 0 or 1")
    _assert_keys(df, keys)
    return df.select(*keys, F.col(label).cast("int").alias("label"))


def _assert_keys(df: DataFrame, keys: list[str]) -> None:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("keys repeat")


def binary_labels(x: Column) -> Column:
    """1 for a true, positive or other non-zero label, 0 for zero, false and missing."""
    return F.coalesce((no_nan(x.cast("double")) != 0).cast("int"), F.lit(0))


@dataclass(frozen=True)
class DetectTask:
    """What is to be detected in which table: columns, window and cutoff."""

    value: str | tuple[str, ...] = "value"
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ("ts",)
    label: str | None = None
    frame: object | None = None
    cutoff: object | None = None

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows before the cutoff of the first order column, and those from it on; all and all without a cutoff."""
        if self.cutoff is None:
            return df, df
        at = F.col(self.order[0])
        return df.where(at < F.lit(self.cutoff)), df.where(at >= F.lit(self.cutoff))


def assert_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """ValueError unless both tables have the same keys, as often."""
    if not a.select(*keys).exceptAll(b.select(*keys)).isEmpty() or not b.select(*keys).exceptAll(a.select(*keys)).isEmpty():
        raise ValueError("the tables are not aligned")


def assert_monotonic(df: DataFrame, at: str, partition: list[str], order: list[str]) -> None:
    """ValueError if a value of ``at`` is below the one before it."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order)
    if not df.select((F.lag(at).over(w) > F.col(at)).alias("back")).where("back").isEmpty():
        raise ValueError(f"{at} is not in order")


def assert_series(df: DataFrame, at: str = "ts", value: str = "value") -> None:
    """ValueError unless a table has a column of times or positions and a column of numbers, by its schema alone."""
    types = dict(df.dtypes)
    if at not in types or value not in types:
        raise ValueError(f"a series has the columns {at} and {value}")
    if types[at] not in ("timestamp", "timestamp_ntz", "date", "string") and not _is_number(types[at]):
        raise ValueError(f"{at} must be a time or a position, not {types[at]}")
    if not _is_number(types[value]):
        raise ValueError(f"{value} must be a number, not {types[value]}")


def assert_panel(df: DataFrame, keys: list[str], at: str = "ts", value: str = "value") -> None:
    """As a series, with key columns that say whose row it is."""
    if not keys or not set(keys) <= set(df.columns):
        raise ValueError(f"a panel has the keys {list(keys)}")
    assert_series(df, at, value)


def _is_number(kind: str) -> bool:
    return kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint", "float", "double")


def run_scoring(df: DataFrame, scorer: Scorer, keys: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    """Checks the table, scores it, and checks that the scores have the same keys and times (a read of both)."""
    assert_panel(df, keys, at, value) if keys else assert_series(df, at, value)
    out = score_anomalies(df, scorer)
    assert_aligned(df, out, [*keys, at])
    return out


def run_detection(df: DataFrame, scorer: Scorer, rule: ThresholdRule | None, keys: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    """As ``run_scoring``, with the flag of the detector, or of the rule within each key."""
    assert_panel(df, keys, at, value) if keys else assert_series(df, at, value)
    out = detect_anomalies(df, scorer, rule, tuple(keys))
    assert_aligned(df, out, [*keys, at])
    return out
