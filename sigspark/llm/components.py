"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge and is not its component's smallest.

    ``edges`` has columns ``hi`` > ``lo`` of any ordered type. Neighbourhoods are never
    gathered: each step is a minimum per node (combined before the shuffle) and a join,
    whose skewed partitions adaptive execution splits. Every round is written to the shared
    scratch folder, so a lost executor costs one round. Runs jobs until every edge leads
    straight to a root.
    """
    now = stored(edges.filter("hi > lo").distinct(), "edges")
    while True:
        low = now.select(F.col("lo").alias("hi")).distinct()
        forked = now.groupBy("hi").agg(F.count("*").alias("n")).join(low.withColumn("is_low", F.lit(True)), "hi", "left")
        if forked.filter("n > 1 OR is_low").isEmpty():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        now = stored(_small_star(_large_star(now)), "edges")
