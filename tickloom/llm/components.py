"""Connected components of a graph given by edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge (a, b).

    Every round hangs each node's neighbours on the smallest one, first the larger neighbours, then
    the smaller; rounds are staged, and their number grows with the logarithm of the graph. Minima are
    combined before the shuffle, and joins on a hub are splittable, so hubs are no bottleneck.
    """
    now = stage(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
                .where("a <> b").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = stage(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (seen.n, seen.s):
            break
        mark = (seen.n, seen.s)
    # now every edge leads from a node to its smallest one
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
