"""Running sums and exact quantiles over the order of a whole table, without a task that sees all rows.

Rows are dealt to ranges of the order; each range's total and the ranges before it (one row a range) give where its own
sums begin. Nothing but those totals and the asked quantiles is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.scratch import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sum of each expression from the first row in the order up to this one. Equal keys meet in one range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {name: f"_own{i}" for i, name in enumerate(sums)}
    dealt = df.withColumns({own[k]: x for k, x in sums.items()}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in own.values()])
    starts = starts.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in own.values()])
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *[(F.col(f"{c}_start") + F.sum(c).over(upto)).alias(name) for name, c in own.items()])


def quantiles(df: DataFrame, asked: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between ranks, nulls left out) of several expressions; null for an expression without values."""
    names = list(asked)
    each = F.array(*[F.struct(F.lit(i).alias("k"), asked[c][0].cast("double").alias("x")) for i, c in enumerate(names)])
    long = df.select(F.explode(each).alias("e")).select("e.*").where("x is not null")
    counts = cut(long.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")), "values")
    total = {r.k: r.n for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # one row for each expression
    before, first = {}, 0
    for k in sorted(total):
        before[k], first = first, first + total[k]
    ranks = {}
    for k in total:
        for p in asked[names[k]][1]:
            at = p * (total[k] - 1)
            ranks[k, p] = (before[k] + math.floor(at), before[k] + math.ceil(at), at - math.floor(at))
    wanted = sorted({r for low, high, _ in ranks.values() for r in (low, high)})
    value: dict[int, float] = {}
    if wanted:
        upto = running(counts, [F.col("k"), F.col("x")], {"upto": F.col("n")})
        held = df.sparkSession.createDataFrame([(r,) for r in wanted], "rank long")
        hits = upto.join(F.broadcast(held), (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        value = {r.rank: r.x for r in hits.select("rank", "x").collect()}  # at most two for each asked quantile
    out: dict[str, list[float | None]] = {}
    for k, name in enumerate(names):
        out[name] = [None] * len(asked[name][1]) if k not in total else [value[ranks[k, p][0]] + ranks[k, p][2] * (value[ranks[k, p][1]] - value[ranks[k, p][0]]) for p in asked[name][1]]
    return out


def quantile(df: DataFrame, x: Column, p: float) -> float | None:
    return quantiles(df, {"x": (x, [p])})["x"][0]
