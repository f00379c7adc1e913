"""A key's call on a stream works on arrays and keeps one state value, so that its cost is not frames and accesses."""

import time

import numpy as np
import pandas as pd

from tidewatch.streaming import stateful
from tidewatch.streaming.stateful import latest_results, process_stream


class _Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, v):
        self.calls += 1
        self.held = v


class _Handle:
    def __init__(self):
        self.made = []

    def getValueState(self, name, schema):
        self.made.append(_Value())
        return self.made[-1]


def test_one_state_value_and_two_accesses():
    own, handle = stateful._Assets("a", 4, {"warning": 2.0}, 3, 5, 0, None), _Handle()
    own.init(handle)
    x, got = np.arange(12.0), []
    for k in range(0, 12, 3):
        part = pd.DataFrame({"a": 1, "at": pd.date_range("2024-01-01", periods=12)[k : k + 3], "value": x[k : k + 3]})
        got.append(next(iter(own.handleInputRows((1,), iter([part]), None))))
    assert len(handle.made) == 1 and handle.made[0].calls == 8
    out = pd.concat(got)
    assert out["mean"].tolist()[3:] == [x[i - 3 : i + 1].mean() for i in range(3, 12)] and out["mean"][:3].isna().all().all()
    assert out["count"].tolist()[2:] == list(range(1, 11)) and out["escalated_level"].tolist()[2:] == ["warning"] * 2 + ["critical"] * 8


def test_a_call_costs_less_than_frames():
    own, handle = stateful._Assets("a", 20, {"warning": 40.0, "critical": 60.0}, 3, 5, 0, None), _Handle()
    own.init(handle)
    part = pd.DataFrame({"a": 1, "at": pd.date_range("2024-01-01", periods=7), "value": np.arange(7.0) * 20})
    call = lambda: next(iter(own.handleInputRows((1,), iter([part]), None)))
    for _ in range(5):
        call()

    def seconds(work):
        times = []
        for _ in range(40):
            t = time.perf_counter()
            work()
            times.append(time.perf_counter() - t)
        return min(times)

    from tidewatch.streaming.maintenance import sliding

    held = np.arange(20.0)
    assert seconds(call) < seconds(lambda: sliding(held, held[:7], 20))


def test_earlier_rows_alone_are_no_result(spark, tmp_path):
    rows = spark.createDataFrame([("x", "2024-01-02 00:00:00", 50.0)], "asset string, at string, value double").selectExpr("asset", "CAST(at AS timestamp) AS at", "value")
    rows.write.parquet(str(tmp_path / "in"))
    earlier = spark.createDataFrame([("x", "2024-01-01 00:00:00", 45.0), ("y", "2024-01-01 00:00:00", 1.0)], "asset string, at string, value double").selectExpr("asset", "CAST(at AS timestamp) AS at", "value")
    out = process_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "asset", "at", "value", 2, {"warning": 40.0}, initial=earlier)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.asset, r.status, r.rows, r["mean"], r["count"]) for r in got] == [("x", "ready", 2, 47.5, 2)]
    assert [(r.asset, r["count"]) for r in latest_results(spark, str(tmp_path / "state"), "asset").collect()] == [("x", 2)]


def test_arrivals_of_several_frames():
    """What a key's call of ``buffered_features`` does, out of order and over two batches."""
    from tidewatch.streaming.maintenance import arrivals, slid

    x, at = np.arange(8.0) ** 2, pd.date_range("2024-01-01", periods=8).to_numpy()
    parts = [pd.DataFrame({"at": at[[3, 1]], "value": x[[3, 1]]}), pd.DataFrame({"at": at[[0, 2]], "value": x[[0, 2]]})]
    when, value = arrivals(iter(parts), "at", "value")
    order = np.argsort(when, kind="stable")
    assert value[order].tolist() == x[:4].tolist()
    rows, made, held = slid(np.empty(0), value[order], 3)
    assert rows.tolist() == [1, 2, 3, 3] and np.isnan(made["mean"][:2]).all() and made["change"][2:].tolist() == [4.0, 8.0]
    rows, made, held = slid(held, x[4:], 3)
    assert rows.tolist() == [3] * 4 and made["mean"].tolist() == [x[i - 2 : i + 1].mean() for i in range(4, 8)] and held.tolist() == x[5:].tolist()
