"""Tables of relational databases: parallel reads by key ranges, writes in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to the database in one statement.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, url: str, table: str, key: str, partitions: int = 16, quote: str = '"', **options: str) -> DataFrame:
    """A table, read by ranges of a numeric key in as many queries as partitions.

    The ranges come from one query for the least and greatest key; filters and columns are pushed into every query. Null
    keys are read with the first range. An empty table gives no rows. quote stands around the key's name in the database.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    ends = reader.option("query", f"SELECT MIN({quote}{key}{quote}) AS low, MAX({quote}{key}{quote}) AS high FROM {table}").load().first()
    low, high = ends[0], ends[1]
    reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table)
    if low is None or low == high:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(partitions)).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 16, **options: str) -> None:
    """Rows into a table, from at most so many connections at once."""
    writer = df.coalesce(partitions).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", str(BATCH_ROWS)).options(**options)
    writer.mode(mode).save()
