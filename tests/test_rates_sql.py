"""Relative changes against their SQL, digit by digit: changes from zero, and quotients that end in a five."""

import datetime

import duckdb
import pytest

from tidewatch.plans.catalog import ORACLE_SQL, QUERIES

#: 5.763 over 0.64 is a tie at six digits; 23.91 over 51.2 at nine.
VALUES = [0.64, 5.763, 3.2, 1.5671, 0.0, 7.5, 0.0, 0.0, 10.24, 17.53, 51.2, 23.91, 6.4, 57.63, 32.0, 15.67]


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("changed"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + i, start + datetime.timedelta(hours=i), u, "view", v) for u in range(3) for i, v in enumerate(VALUES[u:] * 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def both(spark, folder, name, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    names = ", ".join(["event_id", *columns])
    want = con.execute(f"SELECT {names} FROM ({ORACLE_SQL[name]}) ORDER BY event_id").fetchall()
    return [tuple(r) for r in QUERIES[name](spark, folder).select("event_id", *columns).orderBy("event_id").collect()], want


def test_rates(spark, changed):
    got, want = both(spark, changed, "w3_rates", ["value_rate_1", "value_rate_3"])
    assert got == want
    assert any(r[1] == float("inf") for r in got) and any(r[1] is None for r in got[1:])
    assert got[1][1] == 8.004688  # 8.0046875


def test_changes_of_nine_digits(spark, changed):
    got, want = both(spark, changed, "w6_features", ["value_pct_change", "value_roc_5", "value_diff"])
    assert got == want
    assert any(abs(r[1]) < float("inf") and round(r[1], 6) != r[1] for r in got)


def test_rates_of_maintenance(spark, changed):
    got, want = both(spark, changed, "t4_maintenance_features", ["value_rate_1", "value_rate_3", "value_rate_5"])
    assert got == want


@pytest.fixture(scope="module")
def holed(spark, tmp_path_factory):
    """Nulls and NaN among the values: relative changes fill them from before, differences don't."""
    folder = str(tmp_path_factory.mktemp("holed"))
    start = datetime.datetime(2024, 1, 1)
    held = [None, 4.0, None, 5.0, float("nan"), 0.0, None, 2.5, 7.25, None, None, 1.5]
    rows = [(u * 1000 + i, start + datetime.timedelta(hours=i), u, "view", v) for u in range(3) for i, v in enumerate(held[u:] * 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_rates_over_nulls(spark, holed):
    got, want = both(spark, holed, "w3_rates", ["value_rate_1", "value_rate_3"])
    assert got == want
    assert got[2][1] == 0.0 and got[3][1] == 0.25  # 4 is filled in, then 5 is compared with it


def test_features_over_nulls(spark, holed):
    """Half of the values are null or NaN, so that standard deviations lack values, too."""
    names = ["value_pct_change", "value_diff", "value_roc_5", *[f"value_{k}_{n}" for n in (5, 20) for k in ("mean", "std", "min", "max", "median")]]
    got, want = both(spark, holed, "w6_features", names)
    assert got == want


def test_deviations_are_taken_in_order(spark, tmp_path):
    """Large values with small deviations: the ninth digit depends on the order in which squares are summed."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + i, start + datetime.timedelta(hours=i), u, "view", float(1e6 * u + i * i % 97 / 7)) for u in range(1, 40) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, str(tmp_path), "w6_features", [f"value_std_{n}" for n in (5, 10, 20, 50)])
    assert got == want


def test_maintenance_over_nulls(spark, holed):
    names = ["value_rolling_mean", "value_rolling_std", "value_rolling_min", "value_rolling_max", "value_rate_1", "value_rate_3", "value_rate_5"]
    got, want = both(spark, holed, "t4_maintenance_features", names)
    assert got == want
