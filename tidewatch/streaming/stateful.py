"""One stateful stream for each asset: its buffer, features, alerts with escalation, a model's score, and expiry.

State of an asset: one value with its latest result, the number of its alerts and the last rows of its window, read and written
once for a batch, as each access goes from the worker to Spark and back. A timer of event time lets an asset expire that has been silent for ``idle``. A table of earlier rows can be the initial state. The
latest results are read from the checkpoint by Spark's state reader, without a sink of their own. ``process_table`` gives the same
rows from a table by windows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.rules import ALERT_LEVELS, alert_level
from tidewatch.streaming.maintenance import _STATS, arrivals, buffered_features_batch, raised, slid

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_RESULT = "at timestamp, status string, rows int, " + ", ".join(f"{s} double" for s in _STATS) + ", level string, count long, escalated_level string, score double"
_COLUMNS = ["at", "status", "rows", *_STATS, "level", "count", "escalated_level", "score"]


def _levels(x: np.ndarray, thresholds: dict[str, float]) -> np.ndarray:
    out = np.full(len(x), None, object)
    for k in reversed([k for k in ALERT_LEVELS if k in thresholds]):  # the most severe that is reached
        out[x >= thresholds[k]] = k
    return out


class _Assets(StatefulProcessor):
    def __init__(self, asset: str, window: int, thresholds: dict[str, float], to_critical: int, to_failure: int, idle_ms: int, model: Callable[[pd.DataFrame], np.ndarray] | None):
        self.asset, self.window, self.thresholds, self.steps, self.idle_ms, self.model = asset, window, thresholds, (to_critical, to_failure), idle_ms, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _RESULT + ", n long, held array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("at", kind="stable")
        n = (_levels(rows["value"].to_numpy(float), self.thresholds) != None).sum()  # noqa: E711
        self.latest.update((*[None] * len(_COLUMNS), int(n), rows["value"].to_numpy(float)[-self.window :].tolist()))
        self._silent_after(rows["at"].iloc[-1])

    def _silent_after(self, at: pd.Timestamp) -> None:
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(at.timestamp() * 1000) + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, x = arrivals(rows, "at", "value")
        order = np.lexsort((x, at))
        at, x = at[order], x[order]
        old = self.latest.get()
        before, held = (old[-2], np.array(old[-1], float)) if old is not None else (0, np.empty(0))
        rows, made, held = slid(held, x, self.window)
        level = _levels(x, self.thresholds)
        is_alert = level != None  # noqa: E711
        n = before + np.cumsum(is_alert)
        ready = rows == self.window
        count, up, score = (np.full(len(x), None, object) for _ in range(3))
        count[is_alert], up[is_alert] = n[is_alert], raised(level, n, *self.steps)[is_alert]
        out = {self.asset: [key[0]] * len(x), "at": at, "status": np.where(ready, "ready", "buffering"), "rows": rows, **made, "level": level, "count": count, "escalated_level": up, "score": score}
        if self.model is not None and ready.any():
            try:
                score[ready] = np.asarray(self.model(pd.DataFrame(out)[ready]), float)
            except Exception as e:  # the stream goes on without the score
                warnings.warn(f"model failed: {e}", stacklevel=2)
        last = [out[c][-1] for c in _COLUMNS[1:]]
        last = [None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in last]
        self.latest.update((pd.Timestamp(at[-1]).to_pydatetime(), *last, int(n[-1]), held.tolist()))
        self._silent_after(pd.Timestamp(at[-1]))
        yield pd.DataFrame(out, copy=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        self.latest.clear()
        yield pd.DataFrame([[key[0], at, "expired", 0, *[None] * (len(_COLUMNS) - 3)]], columns=[self.asset, *_COLUMNS])

    def close(self) -> None:
        pass


def process_stream(
    rows: DataFrame, asset: str, at: str, value: str, window: int = 100, thresholds: dict[str, float] | None = None, to_critical: int = 3, to_failure: int = 5,
    idle: str | None = None, late: str = "0 seconds", initial: DataFrame | None = None, model: Callable[[pd.DataFrame], np.ndarray] | None = None,
) -> DataFrame:
    """A row for each arrival: asset, at, status, rows, statistics of the last ``window`` values, level, count, escalated_level, score.

    ``idle`` (as "2 hours") adds a row of status "expired" and forgets an asset that had no row for so long in event time, whose clock is
    the watermark (``late`` behind the newest row). ``initial`` has earlier rows (asset, at, value) of some assets. ``model`` gives the scores
    of a batch of whole windows; if it fails, there are a warning and nulls.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = lambda df: df.select(asset, F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).where(F.col("at").isNotNull())
    kind = dict(rows.dtypes)[asset]
    made = _Assets(asset, window, thresholds or {}, to_critical, to_failure, int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0, model)
    stream = own(rows).withWatermark("at", late) if idle else own(rows)
    first = own(initial).groupBy(asset) if initial is not None else None
    return stream.groupBy(asset).transformWithStateInPandas(made, f"`{asset}` {kind}, {_RESULT}", "Append", "EventTime" if idle else "None", first)


def latest_results(spark: SparkSession, checkpoint: str, asset: str) -> DataFrame:
    """asset and the last result of each that has not expired, out of a stream's checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    return state.where("value.status is not null").select(F.col(f"key.{asset}").alias(asset), *[f"value.{c}" for c in _COLUMNS])


def process_table(df: DataFrame, asset: str, at: str, value: str, window: int = 100, thresholds: dict[str, float] | None = None, to_critical: int = 3, to_failure: int = 5) -> DataFrame:
    """The rows of ``process_stream`` (without expiry and score) from a table."""
    own = df.select(asset, F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).where(F.col("at").isNotNull())
    level = alert_level(F.col("value"), thresholds or {}) if thresholds else F.lit(None).cast("string")
    rows = own.withColumn("level", level)
    upto = Window.partitionBy(asset).orderBy("at", "value").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("count", F.when(F.col("level").isNotNull(), F.count("level").over(upto)))
    up = F.when((F.col("level") == "warning") & (F.col("count") >= to_critical), "critical").when((F.col("level") == "critical") & (F.col("count") >= to_failure), "failure").otherwise(F.col("level"))
    made = buffered_features_batch(rows, asset, "at", "value", window, ("level", "count"))
    return made.withColumn("escalated_level", up)
