"""Registered queries and their SQL, by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import aggregates, connectors, graphs, integrity, pipelines, problems, relational, retrieval, streams, texts, validation

MODULES = [problems, retrieval, relational, aggregates, graphs, texts, validation, streams, pipelines, connectors, integrity]

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}
