"""Constrained clustering: greedy merges in order of confidence that respect cannot-links."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.session import cut

#: Accepted pairs of a component that one task takes; larger components are merged round by round over the cluster.
TASK_PAIRS = 500_000


def accepted_pairs(decisions: DataFrame, threshold: float) -> DataFrame:
    """a < b with p and c: matches whose probability and confidence reach the threshold, each pair once with its best values."""
    same = (F.upper(F.trim("decision")) == "SAME") & (F.col("same_probability") >= threshold) & (F.col("confidence") >= threshold)
    pairs = decisions.where(same & F.col("feature_a").isNotNull() & F.col("feature_b").isNotNull() & (F.col("feature_a") != F.col("feature_b")))
    best = F.max(F.struct(F.col("same_probability").alias("p"), F.col("confidence").alias("c"))).alias("m")
    return pairs.groupBy(F.least("feature_a", "feature_b").alias("a"), F.greatest("feature_a", "feature_b").alias("b")).agg(best).select("a", "b", "m.p", "m.c")


def cannot_links(decisions: DataFrame) -> DataFrame:
    """a < b: pairs that are different, whatever their probability."""
    return decisions.where((F.upper(F.trim("decision")) == "DIFFERENT") & F.col("feature_b").isNotNull() & F.col("feature_a").isNotNull() & (F.col("feature_a") != F.col("feature_b"))).select(
        F.least("feature_a", "feature_b").alias("a"), F.greatest("feature_a", "feature_b").alias("b")
    ).distinct()


def merge_in_order(pairs: list[tuple[str, str, float, float]], apart: set[tuple[str, str]]) -> tuple[dict[str, str], list[tuple[str, str, str, str]]]:
    """(feature -> smallest member of its cluster, blocked pairs with the cannot-link that blocks them).

    Pairs are taken by falling probability, then confidence, then name. Of the cannot-links between two clusters the one
    reported is that of the smallest blocked member of the smaller cluster.
    """
    enemies: dict[str, set[str]] = defaultdict(set)
    for a, b in apart:
        enemies[a].add(b)
        enemies[b].add(a)
    cluster: dict[str, list[str]] = {}
    owner: dict[str, str] = {}
    blocked = []
    for a, b, _, _ in sorted(pairs, key=lambda x: (-x[2], -x[3], x[0], x[1])):
        for f in (a, b):
            if f not in owner:
                owner[f] = f
                cluster[f] = [f]
        left, right = cluster[owner[a]], cluster[owner[b]]
        if left is right:
            continue
        small, large = sorted((left, right), key=lambda m: (len(m), min(m)))
        within = set(large)
        hit = min((m for m in small if enemies[m] & within), default=None)
        if hit is not None:
            other = min(enemies[hit] & within)
            blocked.append((a, b, min(hit, other), max(hit, other)))
            continue
        root, gone = sorted((owner[a], owner[b]))
        cluster[root] = cluster[root] + cluster.pop(gone)
        for m in cluster[root]:
            owner[m] = root
    return owner, blocked


_OUT = "kind string, feature string, cluster string, cannot_a string, cannot_b string"


def _component(group: pd.DataFrame) -> pd.DataFrame:
    pairs = group[group["p"].notna()]
    apart = group[group["p"].isna()]
    owner, blocked = merge_in_order(list(pairs[["a", "b", "p", "c"]].itertuples(index=False, name=None)), set(apart[["a", "b"]].itertuples(index=False, name=None)))
    rows = [("member", f, c, None, None) for f, c in owner.items()] + [("conflict", a, b, x, y) for a, b, x, y in blocked]
    return pd.DataFrame(rows, columns=["kind", "feature", "cluster", "cannot_a", "cannot_b"])


def constrained_clusters(decisions: DataFrame, threshold: float) -> DataFrame:
    """kind, feature, cluster, cannot_a, cannot_b: 'member' rows with the cluster's smallest member, and 'conflict' rows
    (a blocked pair in feature and cluster, and the cannot-link that blocks it).

    The order of merges matters only within a component of accepted pairs, so components are independent. A component of
    more than TASK_PAIRS pairs is merged round by round: a pair that is first in order for both of its clusters can be
    decided at once, because nothing before it touches them.
    """
    pairs = cut(accepted_pairs(decisions, threshold))
    apart = cannot_links(decisions)
    found = cut(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    label = found.select(F.col("vertex").alias("a"), "component")
    placed = pairs.join(label, "a")
    inside = apart.join(label, "a").join(found.select(F.col("vertex").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    both = placed.select("component", "a", "b", "p", "c").unionByName(inside.select("component", "a", "b", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("c")))
    sizes = both.groupBy("component").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > TASK_PAIRS).select("component"))
    small = both.join(large, "component", "left_anti").groupBy("component").applyInPandas(_component, _OUT)
    if large.isEmpty():
        return small
    some = both.join(large, "component", "left_semi")
    return small.unionByName(merged_by_rounds(some.where("p is not null").select("a", "b", "p", "c"), some.where("p is null").select("a", "b")))


def merged_by_rounds(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """The same result as merge_in_order, by rounds of joins over the cluster."""
    pairs, apart = cut(pairs), cut(apart)
    members = cut(pairs.select(F.explode(F.array("a", "b")).alias("feature")).distinct().select("feature", F.col("feature").alias("cluster")))
    conflicts = None
    left = pairs
    while True:
        at = lambda side, name: members.select(F.col("feature").alias(side), F.col("cluster").alias(name))
        open_ = cut(left.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x != y").withColumn("o", F.struct((-F.col("p")).alias("p"), (-F.col("c")).alias("c"), F.col("a").alias("a"), F.col("b").alias("b"))))
        if open_.isEmpty():
            break
        first = open_.select(F.explode(F.array("x", "y")).alias("k"), "o").groupBy("k").agg(F.min("o").alias("first"))
        turn = cut(
            open_.join(first.select(F.col("k").alias("x"), F.col("first").alias("fx")), "x").join(first.select(F.col("k").alias("y"), F.col("first").alias("fy")), "y").where("o = fx and o = fy").select("a", "b", "x", "y")
        )
        walls = apart.join(at("a", "ca"), "a").join(at("b", "cb"), "b").select(F.least("ca", "cb").alias("l"), F.greatest("ca", "cb").alias("g"), F.col("a").alias("wa"), F.col("b").alias("wb"), "ca", "cb")
        keyed = turn.select("*", F.least("x", "y").alias("l"), F.greatest("x", "y").alias("g"))
        met = keyed.join(walls, ["l", "g"])
        size = members.groupBy("cluster").agg(F.count("*").alias("n"))
        met = met.join(size.select(F.col("cluster").alias("l"), F.col("n").alias("nl")), "l").join(size.select(F.col("cluster").alias("g"), F.col("n").alias("ng")), "g")
        smaller = F.when(F.col("nl") <= F.col("ng"), F.col("l")).otherwise(F.col("g"))
        mine = F.when(F.col("ca") == smaller, F.col("wa")).otherwise(F.col("wb"))
        theirs = F.when(F.col("ca") == smaller, F.col("wb")).otherwise(F.col("wa"))
        blocked = cut(met.groupBy("a", "b").agg(F.min(F.struct(mine.alias("m"), theirs.alias("t"))).alias("w")))
        rows = blocked.select(F.lit("conflict").alias("kind"), F.col("a").alias("feature"), F.col("b").alias("cluster"), F.least("w.m", "w.t").alias("cannot_a"), F.greatest("w.m", "w.t").alias("cannot_b"))
        conflicts = rows if conflicts is None else conflicts.unionByName(rows)
        merged = keyed.join(blocked, ["a", "b"], "left_anti").select(F.col("g").alias("cluster"), F.col("l").alias("into"))
        members = cut(members.join(merged, "cluster", "left").select("feature", F.coalesce("into", "cluster").alias("cluster")))
        left = cut(open_.join(blocked, ["a", "b"], "left_anti").select("a", "b", "p", "c"))
    nothing = F.lit(None).cast("string")
    out = members.select(F.lit("member").alias("kind"), "feature", "cluster", nothing.alias("cannot_a"), nothing.alias("cannot_b"))
    return out if conflicts is None else out.unionByName(conflicts)
