"""Dependency graphs: levels in topological order, cycles, transitive closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut


def levels(edges: DataFrame, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """((node, level), the nodes on or behind a cycle): level is the longest way from a node without predecessors.

    Each round removes the nodes whose predecessors are all placed; what is left when a round places nothing lies on or
    behind a cycle. Rounds are as many as the longest chain.
    """
    links = cut(edges.select(F.col(before).alias("a"), F.col(after).alias("b")).where("a is not null and b is not null").distinct())
    left = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    placed, level = None, 0
    while not left.isEmpty():
        open_links = links.join(left.select(F.col("node").alias("a")), "a", "left_semi")
        ready = cut(left.join(open_links.select(F.col("b").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        left, level = cut(left.join(ready, "node", "left_anti")), level + 1
    if placed is None:
        placed = left.limit(0).withColumn("level", F.lit(0))
    return placed, left


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, distance: every node reachable from another, with the length of the shortest way; cycles are allowed."""
    base = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct())
    known = frontier = base.withColumn("distance", F.lit(1))
    distance = 1
    while True:
        step = frontier.select("s", F.col("t").alias("m")).join(base.select(F.col("s").alias("m"), "t"), "m").select("s", "t").distinct()
        frontier = cut(step.join(known, ["s", "t"], "left_anti").withColumn("distance", F.lit(distance + 1)))
        if frontier.isEmpty():
            return known.select(F.col("s").alias(source), F.col("t").alias(target), "distance")
        known, distance = cut(known.unionByName(frontier)), distance + 1
