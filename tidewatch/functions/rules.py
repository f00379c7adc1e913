"""Scalar rules as column expressions: thresholds, health states, labels, policy, alerts, time keys."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class HealthState(IntEnum):
    HEALTHY = 0
    WARNING = 1
    DISTRESS = 2


class Action(IntEnum):
    WAIT = 0
    REVIEW = 1
    INTERVENE = 2


def no_nan(c: Column | str) -> Column:
    """NaN becomes null, so that comparisons with it are not true."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def flag(condition: Column) -> Column:
    """1 where a condition is true, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


@dataclass(frozen=True)
class ThresholdRule:
    """``absolute``: a fixed value. ``quantile``: that quantile of the batch (of each partition, if any)."""

    method: str = "absolute"
    value: float | None = None
    quantile: float | None = None

    def __post_init__(self) -> None:
        if self.method not in ("absolute", "quantile"):
            raise ValueError(f"unknown method {self.method!r}")
        if self.method == "quantile" and not (self.quantile is not None and 0 <= self.quantile <= 1):
            raise ValueError("a quantile rule needs a quantile from 0 to 1")
        if self.method == "absolute" and (self.value is None or self.quantile is not None):
            raise ValueError("an absolute rule needs a value and no quantile")


def apply_threshold(df: DataFrame, rule: ThresholdRule, score: str = "score", out: str = "flag", partition: tuple[str, ...] = ()) -> DataFrame:
    """Adds a 0/1 column: score at the threshold or over it. A global quantile is found when this is called."""
    if rule.method == "absolute":
        return df.withColumn(out, flag(no_nan(score) >= F.lit(float(rule.value))))
    if partition:
        exact = F.percentile(no_nan(score), F.lit(float(rule.quantile)))
        return df.withColumn("_limit", exact.over(Window.partitionBy(*partition))).withColumn(out, flag(no_nan(score) >= F.col("_limit"))).drop("_limit")
    from tidewatch.operators.ordering import quantile

    limit = quantile(df, no_nan(score), float(rule.quantile))
    return df.withColumn(out, flag(no_nan(score) >= F.lit(limit)))


def health_from_rul(rul: Column, healthy: float = 30, warning: float = 10) -> Column:
    """Over ``healthy``: 0; at ``warning`` or under: 2; between: 1; unknown: 0."""
    return F.when(rul <= warning, 2).when(rul <= healthy, 1).otherwise(0)


def rul_labels(rul: Column, warning: float = 30, critical: float = 15) -> dict[str, Column]:
    """health_label, binary_label and multi_class_label of remaining useful life."""
    label = F.when(rul > warning, "healthy").when((rul > critical) & (rul <= warning), "warning").when((rul > 0) & (rul <= critical), "critical").when(rul == 0, "failed").otherwise("unknown")
    code = F.when(label == "healthy", 0).when(label == "warning", 1).when(label == "critical", 2).when(label == "failed", 3).otherwise(-1)
    return {"health_label": label, "binary_label": (label != "healthy").cast("int"), "multi_class_label": code}


def health_from_distance(distance: Column, healthy: float, warning: float) -> Column:
    if warning <= healthy:
        raise ValueError("the warning threshold must exceed the healthy one")
    return F.when(distance > warning, 2).when(distance > healthy, 1).otherwise(0)


def health_from_probability(p: Column, risk: float = 0.5, distress: float = 0.8) -> Column:
    """Strictly over ``distress``: 2; strictly over ``risk``: 1."""
    if risk >= distress:
        raise ValueError("the risk threshold must be below the distress one")
    return F.when(p > distress, 2).when(p > risk, 1).otherwise(0)


#: Costs of the actions, base risks of the states, and what an action leaves of the risk (fixed values).
ACTION_COST = {Action.INTERVENE: 100.0, Action.REVIEW: 30.0, Action.WAIT: 0.0}
STATE_RISK = {HealthState.HEALTHY: 0.01, HealthState.WARNING: 0.1, HealthState.DISTRESS: 0.3}
RISK_LEFT = {Action.INTERVENE: 0.5, Action.REVIEW: 0.75, Action.WAIT: 1.0}


def apply_policy(df: DataFrame, state: str = "health_state", previous: str | None = None) -> DataFrame:
    """Adds action, cost and risk: distress is intervened, a change from healthy to warning reviewed, else wait."""
    s = F.col(state)
    action = F.when(s == 2, int(Action.INTERVENE))
    if previous:
        action = action.when((F.col(previous) == 0) & (s == 1), int(Action.REVIEW))
    df = df.withColumn("action", action.otherwise(int(Action.WAIT)))
    a = F.col("action")
    pick = lambda c, table: F.coalesce(*[F.when(c == int(k), F.lit(v)) for k, v in table.items()])
    return df.withColumn("cost", pick(a, ACTION_COST)).withColumn("risk", pick(s, STATE_RISK) * pick(a, RISK_LEFT))


@dataclass(frozen=True)
class PolicyResult:
    """A table of decisions with its states, actions, costs and risks; missing columns are an error."""

    decisions: DataFrame
    keys: tuple[str, ...] = ()
    state: str = "health_state"

    def __post_init__(self) -> None:
        missing = {*self.keys, self.state, "action", "cost", "risk"} - set(self.decisions.columns)
        if missing:
            raise ValueError(f"no columns {sorted(missing)}")

    @classmethod
    def of(cls, df: DataFrame, keys: tuple[str, ...], state: str = "health_state", previous: str | None = None) -> PolicyResult:
        return cls(apply_policy(df, state, previous), keys, state)

    def table(self) -> DataFrame:
        return self.decisions.select(*self.keys, F.col(self.state).alias("health_state"), "action", "cost", "risk")

    def totals(self) -> DataFrame:
        return evaluate_policy(self.decisions)


def evaluate_policy(df: DataFrame) -> DataFrame:
    """total_cost, total_risk, interventions, reviews, waits."""
    return df.agg(F.sum("cost").alias("total_cost"), F.sum("risk").alias("total_risk"), F.count_if(F.col("action") == 2).alias("interventions"), F.count_if(F.col("action") == 1).alias("reviews"), F.count_if(F.col("action") == 0).alias("waits"))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scales a column to 0..1 over the whole table; a constant one stays as it is."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_low", "_high")


def fused_risk(failure: Column, anomaly: Column, failure_weight: float = 0.6, anomaly_weight: float = 0.4) -> Column:
    if failure_weight < 0 or anomaly_weight < 0 or abs(failure_weight + anomaly_weight - 1) > 1e-9:
        raise ValueError("weights must not be negative and must sum to 1")
    return failure_weight * failure + anomaly_weight * anomaly


#: Levels of an alert from the gravest down.
ALERT_LEVELS = ("failure", "critical", "warning", "info")


def alert_level(value: Column, thresholds: dict[str, float]) -> Column:
    """The gravest level whose threshold the value reaches, or null."""
    reached = [F.when(value >= F.lit(float(thresholds[k])), F.lit(k)) for k in ALERT_LEVELS if k in thresholds]
    return F.coalesce(*reached) if reached else F.lit(None).cast("string")


def alert_message(feature: str, value: Column, level: Column, limit: Column) -> Column:
    return F.format_string(f"{feature} = %.2f exceeds %s threshold (%.2f)", value, level, limit)


def seasonal_key(ts: Column, seasonality: str) -> Column:
    """ISO week, month, day of the year, or hour."""
    keys = {"week": F.weekofyear, "month": F.month, "day": F.dayofyear, "hour": F.hour}
    if seasonality not in keys:
        raise ValueError(f"seasonality must be one of {sorted(keys)}")
    return keys[seasonality](ts)


def time_bin(ts: Column, width: str = "1 day") -> Column:
    """The start of the bin of a width ('1 day', '6 hours') that a time lies in."""
    return F.window(ts.cast("timestamp"), width).getField("start")
