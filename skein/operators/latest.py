"""Repeated deliveries and versions: the newest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the one with the greatest order values, later columns breaking ties; nulls are smallest.

    A row number with a limit of one: the limit is also applied before the shuffle, and columns that aren't used later
    are never read, which an aggregation over whole rows would not allow. Rows equal in all order values are tied; any of
    them may come, so give a full order.
    """
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
