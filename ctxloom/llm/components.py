"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, hot_join, staged, unstaged


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round re-links neighbours to the smallest node they know; a hub's
    neighbours are dealt over several parts of the join, never gathered in one
    task.  Links are staged between rounds; nothing but two counters reaches the
    driver.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark, rows = None, edges.count()

    def to_least(many: DataFrame, least: DataFrame) -> DataFrame:
        return hot_join(many, least, "u", "v") if rows > HEAVY else many.join(least, "u")

    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = to_least(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if rows > HEAVY:
            large = staged(large, "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = to_least(large, lower).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, staged(small.where("u > v"), "links", rows)
        unstaged(last, large)
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark, rows = (row.n, row.h), row.n
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
