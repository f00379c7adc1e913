"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest known neighbour until every node points at the
smallest id of its component. All steps are aggregations and joins; the edges are cut to a table after
each round, so neither links nor components come to the driver, and a node with very many links is
only ever aggregated (with partial sums) or split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) for every linked node but the smallest itself."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = cut(links, "links")
    seen = None
    while True:
        mark = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
