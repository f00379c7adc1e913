"""A table streamed from several files: later rows of a user never come before earlier ones."""

import duckdb

from tidewatch.plans.catalog import ORACLE_SQL, QUERIES


def test_alerts_count_in_order_whatever_the_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # each file is a partition of its own, and each part of the stream several files
    rows = [(i, f"2024-01-{1 + i // 200:02d} {i % 24:02d}:00:00", i % 3, "view", 30.0 + i * 7 % 50) for i in range(900)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value")
    for k in (3, 0, 2, 1):  # each file has rows of all parts
        table.where(f"xxhash64(event_id) & 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    names = "event_id, user_id, level, \"count\", escalated_level"
    want = con.execute(f"SELECT {names} FROM ({ORACLE_SQL['t2_escalated_stream']}) ORDER BY event_id").fetchall()
    try:
        got = QUERIES["t2_escalated_stream"](spark, str(tmp_path)).select("event_id", "user_id", "level", "count", "escalated_level").orderBy("event_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert want and [tuple(r) for r in got] == want
