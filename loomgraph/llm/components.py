"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of edges (a, b): label is the smallest node of the component.

    Each step only keeps minima and as many edges as before at most, so a hub
    with a third of all nodes is a sum by key and never one task's list.  Loops
    and repeated edges do not matter; without edges there are no rows.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = stored(now.select(F.col("a").alias("node")).union(now.select("b")).distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct())
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = stored(small.where("a != b").distinct())
        dropped(now, least, large, low)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
