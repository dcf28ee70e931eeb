"""Stores as Parquet folders: named by the hash of their configuration, upserted by key, with graph nodes and edges, and lines as a stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.snapshots import upsert
from skein.sources.rest import _function, with_patience


def store_path(base: str, **configuration: object) -> str:
    """A folder whose name follows from the configuration, so that results of different configurations never mix."""
    text = json.dumps(configuration, sort_keys=True, separators=(",", ":"), default=str)
    return f"{base}/{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version of a store; empty before the first write."""
    try:
        versions = sorted(r.version for r in spark.read.json(f"{path}/versions").select("version").collect())  # one row a write
    except AnalysisException:
        versions = []
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data/{versions[-1]}")


def _commit(df: DataFrame, path: str) -> None:
    """A new version: data first, then the line that makes it current, so that a broken write changes nothing."""
    spark = df.sparkSession
    try:
        last = max(int(r.version) for r in spark.read.json(f"{path}/versions").select("version").collect())
    except (AnalysisException, ValueError):
        last = 0
    version = f"{last + 1:08d}"
    df.write.mode("overwrite").parquet(f"{path}/data/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{path}/versions")


def put(df: DataFrame, path: str, key: str, size: str | None = None, length: int | None = None) -> int:
    """Upsert rows by key; of repeated keys any one is written. size and length: an array column that must have that many
    finite values. Returns how many keys were written."""
    if size is not None:
        sound = (F.size(size) == length) & F.forall(size, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        if not df.where(~F.coalesce(sound, F.lit(False))).isEmpty():
            raise ValueError("a vector has the wrong size or values that aren't finite")
    once = df.dropDuplicates([key])
    _commit(upsert(stored(df.sparkSession, path, _ddl(df)), once, key), path)
    return once.count()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def remove(spark: SparkSession, path: str, schema: str, column: str, values: list[str]) -> None:
    """A new version without the rows of some values, such as a revision."""
    _commit(stored(spark, path, schema).where(~F.coalesce(F.col(column).isin(values), F.lit(False))), path)


def put_graph(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[int, int]:
    """Upsert nodes by key and edges by fact_id. Every edge must have both ends among the given nodes."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("key")).distinct()
    if not ends.join(nodes.select("key"), "key", "left_anti").isEmpty():
        raise ValueError("an edge has an end that is no node")
    return put(nodes, f"{path}/nodes", "key"), put(edges, f"{path}/edges", "fact_id")


def remove_revision(spark: SparkSession, path: str, edge_schema: str, revision: str) -> None:
    """Edges of a revision go; nodes stay, since others may share them."""
    remove(spark, f"{path}/edges", edge_schema, "revision_id", [revision])


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result kept under a path, made on the first call."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def line_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON lines; lines that aren't JSON come with null fields and their text in _line."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", schema).alias("r"), F.col("value").alias("_line")).select("r.*", "_line")


def fetched(keys: DataFrame, key: str, fetch: str) -> DataFrame:
    """key, value (JSON), problem: one answer for each distinct key by fetch(key), named as module:function; a refusal is
    waited for, any other failure is reported in its row."""
    kind = dict(keys.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _function(fetch)
        for batch in batches:
            rows = []
            for k in batch[key]:
                try:
                    rows.append((k, json.dumps(with_patience(lambda k=k: call(k)), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[key, "value", "problem"])

    return keys.where(F.col(key).isNotNull()).select(key).distinct().mapInPandas(run, f"{key} {kind}, value string, problem string")
