"""Versioned corpora: generations of members, barriers, idempotent ingest, upserts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_generation(members: DataFrame, arrivals: DataFrame, key: str) -> DataFrame:
    """Members of the next generation: those of before whose key didn't arrive anew, and the arrivals."""
    return members.join(arrivals.select(key).distinct(), key, "left_anti").unionByName(arrivals)


def barrier(acks: DataFrame, key: str, backend: str, matches: Column, backends: list[str]) -> DataFrame:
    """Keys that every required backend acknowledged with matching versions."""
    good = acks.where(F.col(backend).isin(backends) & F.coalesce(matches, F.lit(False)))
    return good.groupBy(key).agg(F.count_distinct(backend).alias("n")).where(F.col("n") == len(backends)).select(key)


def new_only(arrivals: DataFrame, known: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """Arrivals whose identity isn't known, once each: the first by the given order."""
    row = F.struct(*[F.col(c) for c in arrivals.columns if c not in identity])
    once = arrivals.groupBy(*identity).agg(F.min_by(row, F.struct(*order)).alias("_r")).select(*identity, "_r.*").select(*arrivals.columns)
    return once.join(known.select(*identity).distinct(), identity, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changed rows in place of those with the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left_value, right_value, state: what two stores hold for each key; state is equal, differs, left_only or right_only."""
    a = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, key, "full")
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "equal").otherwise("differs")
    return both.select(key, "left_value", "right_value", state.alias("state"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity, and the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def replayed(patches: Column | str, key: str, value: str) -> Column:
    """The map that a list of patches in order leaves: each sets the value of its key, a null removes it (and stays as null)."""
    # the last patch of a key wins, so keys are taken once, each with the value of its last patch
    ordered = F.reverse(patches)
    keys = F.transform(ordered, lambda p: p[key])
    firsts = F.filter(F.transform(ordered, lambda p, i: F.struct(p[key].alias("k"), p[value].alias("v"), (F.array_position(keys, p[key]) == i + 1).alias("last"))), lambda x: x["last"])
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["k"], x["v"])))
