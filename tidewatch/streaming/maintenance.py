"""Predictive maintenance on streams and batches: sliding buffers by asset, escalating alerts, performance tracking.

State is kept by key: the last rows of an asset, the counts of its alerts, the last results of a model. The same
functions run over a batch (windows over ordered rows) and over a stream (state in the store).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.rules import ALERT_LEVELS, alert_level
from tidewatch.operators.scoring import detection_metrics
from tidewatch.operators.windows import degradation_rates, remaining_life, rolling_statistics
from tidewatch.functions.rules import rul_labels

_STATS = ("mean", "std", "min", "max", "last", "change")


def buffered_features(stream: DataFrame, asset: str, at: str, value: str, window: int = 100) -> DataFrame:
    """asset, at, status, rows and statistics of the last ``window`` rows, one row for each arrival.

    ``status`` is "buffering" until the buffer is full. A count window that slides by one, in state by asset.
    """
    types = dict(stream.dtypes)
    out = f"`{asset}` {types[asset]}, at timestamp, status string, rows int, " + ", ".join(f"{s} double" for s in _STATS)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        when, x = arrivals(parts, at, value)
        order = np.argsort(when, kind="stable")
        rows, made, held = slid(np.array(state.get[0] if state.exists else [], float), x[order], window)
        state.update((held.tolist(),))
        yield pd.DataFrame({asset: [key[0]] * len(x), "at": when[order], "status": np.where(rows == window, "ready", "buffering"), "rows": rows, **made}, copy=False)

    rows = stream.select(asset, F.col(at).cast("timestamp").alias(at), F.col(value).cast("double").alias(value))
    return rows.groupBy(asset).applyInPandasWithState(step, out, "held array<double>", "append", "NoTimeout")


def arrivals(parts: Iterator[pd.DataFrame], at: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """The times and values of an asset's new rows, as arrays: frames cost more than the work on a few rows."""
    held = [(part[at].to_numpy(), part[value].to_numpy(float)) for part in parts]
    return (held[0] if len(held) == 1 else tuple(np.concatenate([h[i] for h in held]) for i in (0, 1)))


def slid(held: np.ndarray, new: np.ndarray, window: int) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """rows and statistics (NaN until the buffer is full) after each arrival, from the rows held before; and the rows held after the last one."""
    both = np.concatenate([held[max(0, len(held) - window + 1) :], new])
    rows = np.minimum(np.arange(len(both) - len(new), len(both)) + 1, window).astype(np.int32)
    made = {k: np.full(len(new), np.nan) for k in _STATS}
    full = np.flatnonzero(rows == window)
    if len(full):
        x = np.lib.stride_tricks.sliding_window_view(both, window)[-len(full) :]
        each = (x.mean(axis=1), x.std(axis=1, ddof=1) if window > 1 else np.full(len(x), np.nan), x.min(axis=1), x.max(axis=1), x[:, -1], x[:, -1] - x[:, 0])
        for k, v in zip(_STATS, each, strict=True):
            made[k][full] = v
    return rows, made, both[-window:]


def sliding(held: np.ndarray, new: np.ndarray, window: int) -> tuple[pd.DataFrame, np.ndarray]:
    """status, rows and statistics after each arrival as a frame; and the rows held after the last one."""
    rows, made, held = slid(held, new, window)
    out = pd.DataFrame({"status": np.where(rows == window, "ready", "buffering"), "rows": rows, **made})
    return out.astype({k: object for k in _STATS}).where(out.notna(), None), held


def buffered_features_batch(df: DataFrame, asset: str, at: str, value: str, window: int = 100, kept: tuple[str, ...] = ()) -> DataFrame:
    """The same over a table, by windows; ``kept`` columns stay."""
    w = Window.partitionBy(asset).orderBy(at).rowsBetween(-(window - 1), 0)
    n, x = F.count(F.lit(1)).over(w), F.col(value).cast("double")
    made = {"mean": F.avg(x).over(w), "std": F.stddev_samp(x).over(w), "min": F.min(x).over(w), "max": F.max(x).over(w), "last": x, "change": x - F.first(x).over(w)}
    return df.select(asset, F.col(at).cast("timestamp").alias("at"), F.when(n == window, "ready").otherwise("buffering").alias("status"), n.cast("int").alias("rows"), *[F.when(n == window, v).alias(k) for k, v in made.items()], *kept)


def alerts(df: DataFrame, asset: str, at: str, thresholds: dict[str, dict[str, float]]) -> DataFrame:
    """asset, at, feature, value, level, threshold, message for each value that reaches a level of its feature."""
    features = [c for c in thresholds if c in df.columns]
    limits: list[Column] = []
    for c in features:
        x = F.col(c).cast("double")
        level = alert_level(x, thresholds[c])
        limit = F.coalesce(*[F.when(level == k, F.lit(float(thresholds[c][k]))) for k in ALERT_LEVELS if k in thresholds[c]])
        limits.append(F.struct(F.lit(c).alias("feature"), x.alias("value"), level.alias("level"), limit.alias("threshold")))
    if not limits:
        raise ValueError("no thresholds for any column")
    rows = df.select(asset, at, F.explode(F.array(*limits)).alias("a")).where("a.level is not null").select(asset, at, "a.*")
    return rows.withColumn("message", F.format_string("%s = %.2f exceeds %s threshold (%.2f)", "feature", "value", "level", "threshold"))


def escalated(found: DataFrame, asset: str, at: str, to_critical: int = 3, to_failure: int = 5) -> DataFrame:
    """Adds ``count`` (alerts of the asset and feature up to this one) and ``escalated_level``.

    A warning becomes critical from ``to_critical`` alerts on, a critical one a failure from ``to_failure`` on. Alerts of one time count in the
    order of their values.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(asset, "feature").orderBy(at, "value").rowsBetween(Window.unboundedPreceding, 0))
    level = F.when((F.col("level") == "warning") & (F.col("count") >= to_critical), "critical").otherwise(F.col("level"))
    return found.withColumn("count", n).withColumn("escalated_level", F.when((level == "critical") & (F.col("level") != "warning") & (F.col("count") >= to_failure), "failure").otherwise(level))


def escalated_stream(found: DataFrame, asset: str, at: str, to_critical: int = 3, to_failure: int = 5) -> DataFrame:
    """The same on a stream of alerts (asset, at, feature, value, level): counts are state by asset and feature, over all micro-batches."""
    types = dict(found.dtypes)
    out = f"`{asset}` {types[asset]}, `{at}` {types[at]}, feature string, value double, level string, count long, escalated_level string"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts)).sort_values([at, "value"], kind="stable")
        n = (state.get[0] if state.exists else 0) + np.arange(1, len(new) + 1)
        state.update((int(n[-1]),))
        yield pd.DataFrame({asset: key[0], at: new[at].to_numpy(), "feature": key[1], "value": new["value"].to_numpy(), "level": new["level"].to_numpy(), "count": n, "escalated_level": raised(new["level"].to_numpy(), n, to_critical, to_failure)})

    return found.select(asset, at, "feature", "value", "level").groupBy(asset, "feature").applyInPandasWithState(step, out, "n long", "append", "NoTimeout")


def raised(level: np.ndarray, n: np.ndarray, to_critical: int, to_failure: int) -> np.ndarray:
    """The levels after escalation by the running counts."""
    out = np.where((level == "warning") & (n >= to_critical), "critical", level)
    return np.where((level == "critical") & (n >= to_failure), "failure", out)


def recent_alerts(found: DataFrame, at: str, n: int = 1000, level: str | None = None, asset: tuple[str, str] | None = None) -> DataFrame:
    """The last n alerts, of a level or an asset if given."""
    if level:
        found = found.where(F.col("level") == level)
    if asset:
        found = found.where(F.col(asset[0]) == asset[1])
    return found.orderBy(F.desc(at), "feature").limit(n)


def maintenance_features(df: DataFrame, asset: str, cycle: str, sensors: list[str] | None = None, window: int = 5, periods: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """RUL, its labels, rolling statistics and rates of all sensors (all other numeric columns if not given)."""
    numeric = ("double", "float", "int", "bigint")
    sensors = sensors or [c for c, t in df.dtypes if t in numeric and c not in (asset, cycle, "RUL")]
    df = remaining_life(df, asset, cycle)
    df = df.withColumns(rul_labels(F.col("RUL")))
    return degradation_rates(rolling_statistics(df, sensors, [asset], [cycle], window), sensors, [asset], [cycle], periods)


def process(df: DataFrame, asset: str, at: str, models: dict[str, object], thresholds: dict[str, dict[str, float]] | None = None, features: Callable[[DataFrame], DataFrame] | None = None, min_rows: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """The latest row of each asset with its features and all models applied, and the alerts of all rows.

    ``features`` makes the models' columns from the rows of all assets. ``status`` is "buffering" for assets of fewer
    than ``min_rows`` rows, whose models' columns are null, and "ready" for the others. A model that can't be applied (it is not
    fitted, or a column is missing) gives a warning and a null column of its name; the others go on.
    """
    own = Window.partitionBy(asset)
    made = features(df) if features else df
    latest = made.withColumn("_n", F.row_number().over(own.orderBy(F.desc(at)))).withColumn("_rows", F.count(F.lit(1)).over(own)).where("_n = 1").drop("_n")
    kept = latest.columns
    for name, m in models.items():
        try:
            latest = m.transform(latest)
        except Exception as e:
            warnings.warn(f"{name} failed: {e}", stacklevel=2)
            latest = latest.withColumn(name, F.lit(None).cast("double"))
    ready = F.col("_rows") >= min_rows
    added = [F.when(ready, F.col(c)).alias(c) for c in latest.columns if c not in kept]
    latest = latest.select(*[c for c in kept if c != "_rows"], *added, F.when(ready, "ready").otherwise("buffering").alias("status"))
    return latest, escalated(alerts(df, asset, at, thresholds), asset, at) if thresholds else None


def asset_dashboard(latest: DataFrame, found: DataFrame, asset: str, at: str, rul: str = "RUL", recent: int = 10) -> DataFrame:
    """The data of a dashboard: asset, its status by remaining life, its alerts by level, and the times of its last alerts."""
    status = F.when(F.col(rul) > 30, "healthy").when(F.col(rul) > 15, "warning").when(F.col(rul) > 0, "critical").otherwise("failed")
    rank = F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(at), "feature"))
    last = found.withColumn("_n", rank)
    counts = [F.count_if(F.col("level") == k).alias(f"n_{k}") for k in ALERT_LEVELS]
    held = last.groupBy(asset).agg(*counts, F.sort_array(F.collect_list(F.when(F.col("_n") <= recent, F.col(at))), asc=False).alias("recent_alerts"))
    return latest.select(asset, status.alias("status")).join(held, asset, "left").na.fill(0, [f"n_{k}" for k in ALERT_LEVELS])


def tracked_performance(df: DataFrame, model: str, at: str, window: int = 1000, base_f1: float | None = None) -> DataFrame:
    """Metrics over each model's last ``window`` results; ``degraded`` where f1 fell by over a tenth from the base."""
    last = df.withColumn("_n", F.row_number().over(Window.partitionBy(model).orderBy(F.desc(at)))).where(F.col("_n") <= window)
    out = detection_metrics(last, by=(model,))
    if base_f1:
        out = out.withColumn("degraded", ((base_f1 - F.col("f1")) / base_f1 > 0.1).cast("int"))
    return out


def event_time_counts(stream: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling windows by key with a watermark: n and mean."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("w.start", "w.end", key, "n", "mean")


def summary(latest: DataFrame, found: DataFrame, rul: str = "RUL") -> tuple[DataFrame, DataFrame]:
    """Dashboards' data: assets by status (over 30, over 15, over 0, else) and alerts by level."""
    status = F.when(F.col(rul) > 30, "healthy").when(F.col(rul) > 15, "warning").when(F.col(rul) > 0, "critical").otherwise("failed")
    return latest.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")), found.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
