"""Consolidating pairwise matches into groups.

Method: a two-dimensional grid. Vertices are hashed into blocks; the edge of two vertices belongs to the cell of their
blocks, so the edges of a vertex of any degree are dealt over a row and a column of cells. Every cell runs union-find over
its own edges and names the smallest vertex of each local tree. The names a vertex has in the cells of its row and column
are exchanged: its parent is the smallest of them, and each other name becomes an edge to that parent. The next round runs
over these edges, which join representatives only, until none is left; then the parents of the rounds are composed from
the last to the first. The smallest vertex of a component is never given up, so it becomes the group key.

Cells have about CELL_EDGES edges, however many there are in all. The edges of every cell are counted; one that a hub has
filled beyond twice that number is split by the hash of the edge, which union-find allows as well as any other division. So
no task grows with the data. Each round is cut with a checkpoint.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

#: Edges of an average cell.
CELL_EDGES = 40_000


def decided_matches(pairs: DataFrame, a: str = "feature_a", b: str = "feature_b", decision: str = "decision", moment: str = "decided_at", match: str = "SAME") -> DataFrame:
    """u < v: unordered pairs whose latest decision is a match.

    Letter case and outer blanks of the decision don't matter; a pair with itself or with a null side is left out. Rows of
    one pair at the same latest moment are a tie: a match among them wins. A null moment is the earliest of all, a null
    decision is no match.
    """
    matched = F.coalesce((F.upper(F.trim(F.col(decision))) == match).cast("int"), F.lit(0))
    return (
        pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.struct(F.col(moment).alias("t"), matched.alias("m")).alias("last"))
        .groupBy("u", "v")
        .agg(F.max("last").alias("last"))
        .where("last.m = 1")
        .select("u", "v")
    )


def local_trees(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Union-find over edges of vertices 0..n-1: the smallest vertex of each vertex's tree.

    All edges are hooked at once, larger root under smaller, and paths are halved until no edge joins two roots.
    """
    parent = np.arange(n)
    while True:
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        if not open_.any():
            return parent
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _cell(group: pd.DataFrame) -> pd.DataFrame:
    codes, words = pd.factorize(pd.concat([group["u"], group["v"]]), sort=True)
    m = len(group)
    root = local_trees(codes[:m], codes[m:], len(words))
    words = np.asarray(words, dtype=object)
    return pd.DataFrame({"x": words, "r": words[root]})


def _celled(edges: DataFrame, count: int) -> DataFrame:
    """u, v with the row, column and part of the cell of each edge."""
    blocks = math.ceil(math.sqrt(count / CELL_EDGES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = edges.select("u", "v", block("u").alias("row"), block("v").alias("column"))
    # at most count / (2 * CELL_EDGES) cells are that full
    full = placed.groupBy("row", "column").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL_EDGES)
    parts = full.select("row", "column", F.ceil(F.col("n") / CELL_EDGES).alias("parts"))
    part = F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1)))
    return placed.join(F.broadcast(parts), ["row", "column"], "left").select("u", "v", "row", "column", part.alias("part"))


def connected_groups(edges: DataFrame) -> DataFrame:
    """group_key, feature_key: every vertex of the edges (u, v) with the smallest vertex it is linked to, directly or through others.

    Without edges there are no rows. Repeated edges and edges in either order give the same groups; an edge of a vertex
    with itself joins nothing and is dropped.
    """
    edges = cut(edges.where("u != v").select("u", "v"))
    count = edges.count()
    rounds: list[DataFrame] = []
    while count:
        one = count <= CELL_EDGES
        cells = edges.select("u", "v", F.lit(0).alias("row")).groupBy("row") if one else _celled(edges, count).groupBy("row", "column", "part")
        named = cells.applyInPandas(_cell, "x string, r string")
        if one:
            rounds.append(cut(named.select("x", F.col("r").alias("parent"))))
            break  # one cell holds every edge: its trees are final
        # a vertex has one name in each of its cells: the smallest is its parent, the others become edges to it
        w = Window.partitionBy("x").orderBy("r")
        ranked = cut(named.select("x", "r", F.first("r").over(w).alias("parent"), F.row_number().over(w).alias("n")))
        rounds.append(ranked.where("n = 1").select("x", "parent"))
        edges = cut(ranked.where("r != parent").select(F.col("parent").alias("u"), F.col("r").alias("v")).distinct())
        count = edges.count()
    if not rounds:
        return edges.select(F.col("u").alias("group_key"), F.col("v").alias("feature_key"))
    final = rounds.pop()
    while rounds:
        before = rounds.pop()
        later = final.select(F.col("x").alias("parent"), F.col("parent").alias("root"))
        final = before.join(later, "parent", "left").select("x", F.coalesce("root", "parent").alias("parent"))
    return final.select(F.col("parent").alias("group_key"), F.col("x").alias("feature_key"))
