"""Evaluation measures and the quantile definitions in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(over: Column, under: Column, empty: float | None = 0.0) -> Column:
    """over / under; `empty` where there is nothing to divide by."""
    return F.when(under != 0, over / under).otherwise(F.lit(empty).cast("double"))


def truncated_quantile(value: Column, p: float) -> Column:
    """The value at place int((n - 1) * p) of the sorted values."""
    v = F.array_sort(F.collect_list(value))
    return F.when(F.size(v) > 0, F.element_at(v, (F.floor((F.size(v) - 1) * F.lit(p)) + 1).cast("int")))


def floor_quantile(value: Column, p: float) -> Column:
    """The value at place max(0, int(n * p) - 1) of the sorted values."""
    v = F.array_sort(F.collect_list(value))
    return F.when(F.size(v) > 0, F.element_at(v, (F.greatest(F.lit(0), F.floor(F.size(v) * F.lit(p)) - 1) + 1).cast("int")))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """gold, predicted, n."""
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def per_class(cells: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support from confusion cells; ratios without a denominator are 0."""
    got = cells.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    said = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    both = got.join(said, "label", "full").fillna(0, ["support", "hits", "said"])
    p, r = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    return both.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def threshold_sweep(rows: DataFrame, gold: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall, f1, accepted, false_accept_rate: one pass over the rows for all thresholds."""
    parts = []
    for i, t in enumerate(thresholds):
        yes = score >= t
        parts += [F.count_if(yes & gold).alias(f"tp{i}"), F.count_if(yes & ~gold).alias(f"fp{i}")]
    sums = rows.agg(*parts, F.count_if(gold).alias("pos"), F.count_if(~gold).alias("neg"))
    stacked = ", ".join(f"CAST({t} AS DOUBLE), tp{i}, fp{i}" for i, t in enumerate(thresholds))
    each = sums.selectExpr("pos", "neg", f"stack({len(thresholds)}, {stacked}) AS (threshold, tp, fp)")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))
    return each.select("threshold", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fp")).alias("accepted"), ratio(F.col("fp"), F.col("neg")).alias("false_accept_rate"))


def ranking_measures(ranked: DataFrame, query: str, rank: str, relevant: Column, k: int) -> DataFrame:
    """query, recall_at_k, reciprocal_rank, top_k_hit; recall and reciprocal rank are null for a query without relevant rows."""
    r = F.coalesce(relevant, F.lit(False))
    per = ranked.groupBy(query).agg(F.count_if(r).alias("wanted"), F.count_if(r & (F.col(rank) <= k)).alias("found"), F.min(F.when(r, F.col(rank))).alias("first"))
    return per.select(query, ratio(F.col("found"), F.col("wanted"), None).alias("recall_at_k"), (1.0 / F.col("first")).alias("reciprocal_rank"), (F.col("found") > 0).alias("top_k_hit"))
