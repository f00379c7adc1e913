"""Concordance counts: longs move, only products are decimals, and those stay exact beyond 64 bits."""

from pyspark.sql import functions as F

from tidewatch.operators import survival


def test_products_beyond_64_bits_and_long_sums(spark, monkeypatch):
    seen = []
    real = survival.running
    monkeypatch.setattr(survival, "running", lambda df, order, sums: seen.append(dict(df.dtypes)) or real(df, order, sums))
    rows = spark.createDataFrame([(0, 1, 1.0, 1 << 40, 0), (0, 0, 2.0, 0, 1 << 40), (0, 1, 3.0, 5, 0)], "g int, k long, pos double, held long, asked long")
    assert survival._won(rows).first().won == float(1 << 80)
    assert seen[0]["held"] == seen[0]["asked"] == "bigint"
    assert survival._won(rows.where(F.lit(False))).first().won == 0.0
