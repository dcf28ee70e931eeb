"""Ranks over whole tables, fusion of ranked lists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut

RRF_K = 60


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with a 1-based row number inside each group, by the given order.

    A group may be any share of the table: rows are range-partitioned by group and order, so a group spreads over as many
    tasks as its size needs; each task numbers its rows and adds how many rows of the group earlier tasks hold. Only those
    counts, one for each task and group border, go through the driver. The sorted rows are cut, which fixes their places.
    """
    placed = cut(df.repartitionByRange(*[F.col(g) for g in groups], *order).sortWithinPartitions(*[F.col(g) for g in groups], *order))
    task, place = F.spark_partition_id(), F.monotonically_increasing_id() % (1 << 33)
    placed = placed.withColumn("_task", task).withColumn("_place", place)
    borders = placed.groupBy(*groups, "_task").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = F.sum("_n").over(_before(groups)) if groups else F.sum("_n").over(_before([]))
    borders = borders.withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
    keys = [*groups, "_task"]
    return placed.join(borders.drop("_n"), keys).withColumn(name, F.col("_place") - F.col("_first") + 1 + F.col("_earlier")).drop("_task", "_place", "_first", "_earlier")


def _before(groups: list[str]):
    from pyspark.sql import Window

    # one row per task and group
    return Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)


def reciprocal_rank_fusion(candidates: DataFrame, list_name: str, key: str, chunk: str, section: str, order: list[Column], channels: str, k: int = RRF_K) -> DataFrame:
    """key, score, chunk, section, channels: lists fused by the sum of 1 / (k + rank).

    Ranks count every row of a list, but only a key's first row in a list contributes. The chunk of a key is the one with
    the most contribution, then the smallest section, then the smallest chunk; channels are those of contributing rows.
    """
    rows = ranked(candidates, [list_name], order)
    first = rows.groupBy(list_name, key).agg(F.min_by(F.struct(chunk, section, channels, "rank"), "rank").alias("r"))
    part = first.select(key, F.col(f"r.{chunk}").alias(chunk), F.col(f"r.{section}").alias(section), F.col(f"r.{channels}").alias(channels), (1.0 / (k + F.col("r.rank"))).alias("part"))
    per_chunk = part.groupBy(key, chunk).agg(F.sum("part").alias("part"), F.min(section).alias(section), F.array_distinct(F.flatten(F.collect_list(channels))).alias(channels))
    best = F.min_by(F.struct(chunk, section), F.struct(-F.round("part", 12), F.col(section), F.col(chunk)))
    fused = per_chunk.groupBy(key).agg(F.sum("part").alias("score"), best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(channels)))).alias(channels))
    return fused.select(key, "score", f"b.{chunk}", f"b.{section}", channels)


def page_after(df: DataFrame, at: Column, after_at, row_id: Column, after_id, size: int) -> DataFrame:
    """A page of a list in descending (at, id) order behind a cursor, with one row more to tell whether another page follows."""
    behind = (at < after_at) | ((at == after_at) & (row_id > after_id))
    return df.where(behind).orderBy(at.desc(), row_id.asc()).limit(size + 1)
