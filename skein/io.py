"""Readers of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; columns and filters are pushed into the scan by the optimizer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
