"""The stateful stream over many micro-batches, a restart, initial state, expiry, the state reader and a failing model."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.scoring import ZScore
from tidewatch.streaming import maintenance
from tidewatch.streaming.stateful import latest_results, process_stream, process_table

START = dt.datetime(2024, 1, 1)
SCHEMA = "asset string, ts timestamp, value double"
LIMITS = {"warning": 5.0, "critical": 8.0, "failure": 30.0}
KEYS = ["asset", "at", "status", "rows", "mean", "std", "min", "max", "last", "change", "level", "count", "escalated_level"]


def made(n, assets="xyz", start=0):
    return [(a, START + dt.timedelta(minutes=i), float((i * (k + 2)) % 11)) for i in range(start, start + n) for k, a in enumerate(assets)]


def fill(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, stream, path):
    q = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)


def plain(df):
    rows = [tuple(r[k] for k in KEYS) for r in df.collect()]
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)


def test_micro_batches_and_restart_equal_the_table(spark, tmp_path):
    rows = made(50)
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k in range(10):
        fill(spark, tmp_path / "in", [r for r in rows if k * 5 <= (r[1] - START).seconds // 60 < k * 5 + 5])
        if k in (3, 9):  # stopped after four files and started again from the checkpoint
            run(spark, process_stream(source(), "asset", "ts", "value", 7, LIMITS), tmp_path)
    want = process_table(spark.createDataFrame(rows, SCHEMA), "asset", "ts", "value", 7, LIMITS)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert plain(got) == plain(want) and got.count() == 150
    latest = {r.asset: r for r in latest_results(spark, str(tmp_path / "state"), "asset").collect()}
    assert set(latest) == set("xyz")
    for r in want.where(F.col("at") == max(x[1] for x in rows)).collect():
        assert latest[r.asset]["mean"] == pytest.approx(r["mean"]) and latest[r.asset].escalated_level == r.escalated_level


def test_initial_state(spark, tmp_path):
    rows = made(20, "xy")
    early, later = [r for r in rows if r[1] < START + dt.timedelta(minutes=12)], [r for r in rows if r[1] >= START + dt.timedelta(minutes=12)]
    fill(spark, tmp_path / "in", later)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    run(spark, process_stream(stream, "asset", "ts", "value", 7, LIMITS, initial=spark.createDataFrame(early, SCHEMA)), tmp_path)
    want = process_table(spark.createDataFrame(rows, SCHEMA), "asset", "ts", "value", 7, LIMITS).where(F.col("at") >= START + dt.timedelta(minutes=12))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(want)


def test_silent_assets_expire(spark, tmp_path):
    for part in (made(10, "xy"), made(10, "x", 30), made(5, "x", 60)):
        fill(spark, tmp_path / "in", part)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(spark, process_stream(stream, "asset", "ts", "value", 3, idle="25 minutes"), tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    gone = {(r.asset, r.at) for r in out.where("status = 'expired'").collect()}
    assert ("y", START + dt.timedelta(minutes=34)) in gone and not any(a == "x" for a, _ in gone)
    assert {r.asset for r in latest_results(spark, str(tmp_path / "state"), "asset").collect()} == {"x"}


def test_models_and_their_failures(spark, tmp_path):
    fill(spark, tmp_path / "in", made(12, "x"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    run(spark, process_stream(stream(), "asset", "ts", "value", 4, model=lambda x: x["max"].astype(float) - x["min"].astype(float)), tmp_path / "a")
    got = spark.read.parquet(str(tmp_path / "a" / "out")).collect()
    assert all((r.score is None) == (r.status == "buffering") and (r.score is None or r.score == r["max"] - r["min"]) for r in got) and len(got) == 12

    def broken(x):
        raise ValueError("no")

    run(spark, process_stream(stream(), "asset", "ts", "value", 4, model=broken), tmp_path / "b")
    assert [r.score for r in spark.read.parquet(str(tmp_path / "b" / "out")).collect()] == [None] * 12
    table = spark.createDataFrame(made(12, "xy"), SCHEMA)
    with pytest.warns(UserWarning, match="bad failed"):
        latest, _ = maintenance.process(table, "asset", "ts", {"bad": ZScore(("value",)), "good": ZScore(("value",)).fit(table)})
    assert all(r.bad is None and r.score is not None for r in latest.collect())


def test_sliding_windows():
    rng = np.random.default_rng(1)
    x, held, out = rng.standard_normal(40), np.zeros(0), []
    for part in np.array_split(x, [1, 2, 9, 30]):
        rows, held = maintenance.sliding(held, part, 6)
        out += rows["mean"].tolist()
    assert out == [None if i < 5 else pytest.approx(x[i - 5 : i + 1].mean()) for i in range(40)] and np.allclose(held, x[-6:])
