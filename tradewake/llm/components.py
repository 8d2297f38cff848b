"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewake.session import cut_lineage


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node that has an edge.

    Alternates two steps until the edges stay the same. Large step: every node links its larger
    neighbours to the smallest node it sees. Small step: every node links its smaller
    neighbours, and itself, to the smallest of them. Rounds grow with the
    logarithm of the longest path; edges never grow in number. Each step is an aggregate
    with map-side combining and a join that can be split at run time, so a node with
    many edges doesn't land in one task. Every round is written out.
    """
    current = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        around = both_ways(current)
        least = cut_lineage(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        following = cut_lineage(small.select("e.*").filter("a <> b").distinct())
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (current, following)]
        if sums[0] == sums[1]:
            roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        current = following
