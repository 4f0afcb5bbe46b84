"""Connected components by alternating large and small stars, all in aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the least of u and all its v as m. The least values are written out first, so that Spark can split a hot u in the join."""
    least = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return edges.join(least, "u")


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of an edge (a, b); no rows for an empty table.

    Every round is checkpointed; the rounds grow with the logarithm of the longest path. Loops (a = b) and repeated
    edges do no harm; edges with a null end are left out.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = _star(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    tails = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tails.unionByName(tails.select(F.col("root").alias("node"), "root")).distinct()
