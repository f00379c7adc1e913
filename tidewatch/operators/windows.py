"""Per-entity operators over ordered rows: rolling statistics, changes, run lengths, lead times, folds, sequences.

All columns of one call share one window specification, so Catalyst sorts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.rules import no_nan


def ordered(partition: list[str], order: list[str]) -> WindowSpec:
    return (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order)


@dataclass(frozen=True)
class Frame:
    """A window of ``length`` rows, every ``step``-th row kept, aligned right, left or center."""

    length: int
    step: int = 1
    alignment: str = "right"

    def __post_init__(self) -> None:
        if self.length <= 0 or self.step <= 0:
            raise ValueError("length and step must be positive")
        if self.alignment not in ("left", "right", "center"):
            raise ValueError("alignment must be left, right or center")

    def over(self, w: WindowSpec) -> WindowSpec:
        before = {"right": self.length - 1, "left": 0, "center": (self.length - 1) // 2}[self.alignment]
        return w.rowsBetween(-before, self.length - 1 - before)

    def kept(self, w: WindowSpec) -> Column:
        return (F.row_number().over(w) - 1) % self.step == 0


def rolling_statistics(df: DataFrame, columns: list[str], partition: list[str], order: list[str], window: int = 5, stats: tuple[str, ...] = ("mean", "std", "min", "max")) -> DataFrame:
    """Adds ``{column}_rolling_{stat}`` over the last ``window`` rows (fewer at the start); std is the sample's."""
    w = ordered(partition, order).rowsBetween(-(window - 1), 0)
    made = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5), "q25": lambda c: F.percentile(c, 0.25), "q75": lambda c: F.percentile(c, 0.75)}
    return df.withColumns({f"{c}_rolling_{s}": made[s](no_nan(c)).over(w) for c in columns if c in df.columns for s in stats})


def percent_change(x: Column, w: WindowSpec, periods: int = 1) -> Column:
    """Relative change; a change from zero is infinite (null from zero to zero). Nulls are filled from before."""
    filled = F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, -periods))
    grown = F.when(filled > 0, F.lit(float("inf"))).when(filled < 0, F.lit(float("-inf")))
    return F.when(before == 0, grown).otherwise(F.try_divide(filled, before) - 1)


def degradation_rates(df: DataFrame, columns: list[str], partition: list[str], order: list[str], periods: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    w = ordered(partition, order)
    return df.withColumns({f"{c}_rate_{p}": percent_change(no_nan(c), w, p) for c in columns for p in periods})


def change_features(df: DataFrame, columns: list[str], partition: list[str], order: list[str], spans: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """First and second differences, their sizes, relative change, and the mean change over several rows."""
    w, out = ordered(partition, order), {}
    for c in columns:
        x = no_nan(c)
        d1 = x - F.lag(x, 1).over(w)
        d2 = x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)
        out |= {f"{c}_diff": d1, f"{c}_diff2": d2, f"{c}_abs_diff": F.abs(d1), f"{c}_abs_diff2": F.abs(d2), f"{c}_pct_change": percent_change(x, w)}
        out |= {f"{c}_roc_{k}": (x - F.lag(x, k).over(w)) / k for k in spans}
    return df.withColumns(out)


def backfilled(df: DataFrame, columns: list[str], partition: list[str], order: list[str]) -> DataFrame:
    """Nulls get the next value, or 0. Looks ahead: for batches only."""
    w = ordered(partition, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.first(no_nan(c), True).over(w), F.lit(0.0)) for c in columns})


def sorted_quantile(held: Column, q: float) -> Column:
    """A quantile (linear between ranks) of a sorted array; null for an empty one."""
    at = (F.size(held) - 1) * F.lit(q)
    low, high = F.get(held, F.floor(at).cast("int")), F.get(held, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def extract_features(df: DataFrame, columns: list[str], partition: list[str], order: list[str], windows: tuple[int, ...] = (5, 10, 20, 50, 100)) -> DataFrame:
    """Rolling and change features of all columns, back-filled; windows longer than an entity's series give 0."""
    w, out = ordered(partition, order), {}
    count = F.count(F.lit(1)).over(Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0)))
    for c in columns:
        x = no_nan(c)
        for n in windows:
            own = w.rowsBetween(-(n - 1), 0)
            made = {"mean": F.avg(x).over(own), "std": F.stddev_samp(x).over(own), "min": F.min(x).over(own), "max": F.max(x).over(own), "_held": F.collect_list(x).over(own)}
            out |= {f"{c}_{k}_{n}": F.when(count >= n, v) for k, v in made.items()}
    kept = df.columns
    df = df.withColumns(out)
    held = [f"{c}__held_{n}" for c in columns for n in windows]
    df = df.withColumns({h: F.array_sort(h) for h in held})  # sorted once for all quantiles of a window
    out = {}
    for c in columns:
        for n in windows:
            low, middle, high = (sorted_quantile(F.col(f"{c}__held_{n}"), q) for q in (0.25, 0.5, 0.75))
            out |= {f"{c}_median_{n}": middle, f"{c}_q25_{n}": low, f"{c}_q75_{n}": high, f"{c}_iqr_{n}": high - low}
    df = change_features(df.withColumns(out), columns, partition, order)
    df = df.drop(*held)
    return backfilled(df, [c for c in df.columns if c not in kept], partition, order)


def spectral_features(df: DataFrame, columns: list[str], partition: list[str], order: list[str]) -> DataFrame:
    """One row for each entity: dominant frequency, spectral centroid and 85 % roll-off of each column's series.

    Series of ten values or fewer give null. An entity's series meets in one task, as it must for a transform.
    """
    import numpy as np
    import pandas as pd

    names = [f"{c}_{k}" for c in columns for k in ("dominant_freq", "spectral_centroid", "spectral_rolloff")]

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, row = pdf.sort_values(order), [pdf[p].iloc[0] for p in partition]
        for c in columns:
            x = pdf[c].dropna().to_numpy(float)
            if len(x) <= 10:
                row += [None, None, None]
                continue
            power, freq = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(len(x))
            total, upto = power.sum(), np.cumsum(power)
            row += [float(freq[1:][power[1:].argmax()]), float((freq * power).sum() / total) if total else 0.0, float(freq[np.searchsorted(upto, 0.85 * total)]) if total else 0.0]
        return pd.DataFrame([row], columns=[*partition, *names])

    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{p}` {types[p]}" for p in partition], *[f"`{n}` double" for n in names]])
    return df.select(*partition, *order, *columns).groupBy(*partition).applyInPandas(transform, schema)


def change_points(df: DataFrame, value: str, partition: list[str], order: list[str], window: int = 10, multiplier: float = 3.0) -> DataFrame:
    """score: the larger of the deviations from the entity's mean and from the last rows' mean; flag at the multiplier."""
    x, part = no_nan(value), Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    own = ordered(partition, order).rowsBetween(-(window - 1), 0)
    unit = lambda s: F.when(s > 0, s).otherwise(1.0)
    whole = F.abs(x - F.avg(x).over(part)) / unit(F.stddev_pop(x).over(part))
    local = F.abs(x - F.avg(x).over(own)) / unit(F.stddev_samp(x).over(own))
    df = df.withColumn("score", F.greatest(whole, local))
    return df.withColumn("flag", F.coalesce(F.col("score") >= multiplier, F.lit(False)).cast("int"))


def run_lengths(df: DataFrame, flag: str, partition: list[str], order: list[str]) -> DataFrame:
    """average_run_length of the runs of 1 of each entity (of the whole table without partition), 0 without any."""
    starts = ((F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(ordered(partition, order)), F.lit(0)) == 0)).cast("int")
    df = df.withColumn("_starts", starts)
    return df.groupBy(*partition).agg(F.coalesce(F.try_divide(F.sum(F.col(flag).cast("double")), F.sum("_starts")), F.lit(0.0)).alias("average_run_length"))


def lead_times(df: DataFrame, predicted: str, truth: str, at: str, partition: list[str]) -> DataFrame:
    """Time from the last detection at or before each rise of the truth: mean, median, min, max, early and late counts."""
    w = ordered(partition, [at])
    rises = (F.col(truth) == 1) & (F.lag(truth).over(w) == 0)
    seen = F.last(F.when(F.col(predicted) == 1, F.col(at)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    events = df.select(*partition, rises.alias("rise"), (F.col(at).cast("double") - seen.cast("double")).alias("lead")).where("rise")
    lead = F.when(F.col("lead") > 0, F.col("lead"))
    return events.groupBy(*partition).agg(F.avg(lead).alias("mean_lead"), F.median(lead).alias("median_lead"), F.min(lead).alias("min_lead"), F.max(lead).alias("max_lead"), F.count_if(F.col("lead") > 0).alias("early"), F.count_if(F.col("lead") < 0).alias("late"))


def expanding_folds(n: int, n_splits: int = 5, min_train: int = 10) -> list[tuple[int, int]]:
    """(train_end, test_start) of growing training windows over n rows."""
    if n < min_train + n_splits:
        raise ValueError("too few rows for so many folds")
    step = (n - min_train) // n_splits
    return [(min_train + i * step, min_train + i * step) for i in range(n_splits)]


def sliding_folds(n: int, n_splits: int = 5, train: int = 20, test: int = 10) -> list[tuple[int, int]]:
    """(train_end, test_start) of windows of equal length."""
    if n < train + test:
        raise ValueError("too few rows for a window")
    step = max(1, (n - train - test) // max(1, n_splits))
    return [(train + i * step, train + i * step) for i in range(n_splits) if train + test + i * step <= n]


def sequences(df: DataFrame, sensors: list[str], target: str, partition: list[str], order: list[str], window: int = 30) -> DataFrame:
    """For each row after the first ``window`` ones of its entity: the sensors of the rows before it, and its target."""
    w = ordered(partition, order)
    past = F.collect_list(F.array(*[no_nan(s) for s in sensors])).over(w.rowsBetween(-window, -1))
    return df.select(*partition, *order, past.alias("sequence"), F.col(target).alias("label"), F.row_number().over(w).alias("_at")).where(F.col("_at") > window).drop("_at")


def remaining_life(df: DataFrame, asset: str, cycle: str, failure: str | None = None, out: str = "RUL") -> DataFrame:
    """Cycles to the asset's last (or given) cycle, not below 0."""
    last = F.max(failure or cycle).over(Window.partitionBy(asset))
    return df.withColumn(out, F.greatest(last - F.col(cycle), F.lit(0)))
