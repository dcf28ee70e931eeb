"""Paged web services as a Spark data source: cursor pages in one reader, offset windows as partitions.

The fetch function is given by name (module:function), so that tests and offline runs can serve pages from files. Waiting
and repeating after a refusal happens in the reader.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows a page may have, and rows that offset windows may reach.
PAGE_LIMIT, WINDOW_LIMIT = 100, 2000


class Refused(Exception):
    """The service asks to wait; `after` in seconds if it says how long."""

    def __init__(self, after: float | None = None):
        super().__init__("refused")
        self.after = after


def with_patience(call: Callable[[], dict], attempts: int = 5, base: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer of call, repeated after refusals with doubling waits, or as long as the service asks, up to a limit."""
    for n in range(attempts):
        try:
            return call()
        except Refused as e:
            if n == attempts - 1:
                raise
            sleep(min(e.after if e.after is not None else base * 2**n, most))
    raise AssertionError("unreachable")


def _function(name: str) -> Callable[..., dict]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class _Window(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))


class _Cursor(InputPartition):
    pass


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.query = options.get("query", "")
        self.fetch = options["fetch"]
        self.size = min(int(options.get("pagesize", 25)), PAGE_LIMIT)
        self.limit = int(options.get("limit", WINDOW_LIMIT))
        self.cursor = options.get("paging", "cursor") == "cursor"

    def partitions(self) -> list[InputPartition]:
        if self.cursor:
            return [_Cursor(None)]
        end = min(self.limit, WINDOW_LIMIT)
        return [_Window(a, min(a + self.size, end)) for a in range(0, end, self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = _function(self.fetch)
        if isinstance(partition, _Window):
            start, stop = partition.value
            page = with_patience(lambda: fetch(self.query, start=start, stop=stop))
            for row in page.get("results", []):
                yield (json.dumps(row, ensure_ascii=False),)
            return
        cursor, left = "*", self.limit
        while cursor and left > 0:
            page = with_patience(lambda: fetch(self.query, cursor=cursor, size=min(self.size, left)))  # noqa: B023
            rows = page.get("results", [])
            for row in rows[:left]:
                yield (json.dumps(row, ensure_ascii=False),)
            left -= len(rows)
            cursor = page.get("next_cursor") if rows else None


class PagedSource(DataSource):
    """spark.read.format("paged_rest").option("fetch", "module:function").option("query", ...).load(): a column value of JSON."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
