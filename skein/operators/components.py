"""Connected components as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """vertex, component: the smallest vertex reachable from each; isolated vertices are their own component.

    edges: columns u and v of one type, in any direction, with repeats. vertices: a column vertex. Large-star and
    small-star rounds alternate until nothing changes, which takes logarithmically many rounds in practice; every round is
    cut. Aggregations and joins go by vertex; adaptive execution splits the join of a vertex with many edges.
    """
    now = cut(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = cut(_small_star(_large_star(now)))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    found = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    found = found.unionByName(roots)
    if vertices is not None:
        alone = vertices.select("vertex").distinct().join(found, "vertex", "left_anti")
        found = found.unionByName(alone.select("vertex", F.col("vertex").alias("component")))
    return found
