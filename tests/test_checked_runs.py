"""Checks of series and panels by their schema, and runs that check what they are given and give."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.rules import ThresholdRule
from tidewatch.operators.scoring import RobustZScore, Scorer, assert_panel, assert_series, run_detection, run_scoring


class Loses(Scorer):
    def transform(self, df):
        return df.where("ts > 0").withColumn("score", F.lit(0.0))


def test_checked_runs(spark):
    df = spark.createDataFrame([("p", i, float(i % 3)) for i in range(9)] + [("q", 0, 50.0), ("q", 0, 50.0), ("q", 1, None)], "unit string, ts int, value double")
    assert_series(df)
    assert_panel(df, ["unit"])
    for bad in (lambda: assert_series(df, value="unit"), lambda: assert_series(df, at="none"), lambda: assert_panel(df, []), lambda: assert_panel(df, ["none"])):
        with pytest.raises(ValueError):
            bad()
    scorer = RobustZScore(partition=("unit",)).fit(df)
    assert run_scoring(df, scorer, ["unit"]).count() == 12  # repeated rows stay
    flags = run_detection(df, scorer, ThresholdRule("quantile", quantile=0.9), ["unit"])
    assert {r.unit: r.n for r in flags.groupBy("unit").agg(F.sum("flag").alias("n")).collect()}["p"] >= 1
    with pytest.raises(ValueError):
        run_scoring(df, Loses(), ["unit"])
    assert run_scoring(df.limit(0), scorer, ["unit"]).count() == 0
