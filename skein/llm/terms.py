"""Frequency of every distinct value or term.

Method. Every block of records (what a task reads until it holds BLOCK_TERMS different terms) encodes its terms by a local
dictionary and accumulates count arrays for occurrences, record presence and weight, so that a term leaves a block once
however often it occurs there. The blocks' entries are counted and dealt by the hash of the term over identifier ranges of
about RANGE_ENTRIES entries. A range numbers its distinct terms densely (the global identifier is the range and that number),
adds the blocks' arrays by identifier and returns one row per term.

A term that a third of all records hold is one entry per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut, dealt

#: Different terms after which a block is closed.
BLOCK_TERMS = 300_000
#: Entries of blocks in one identifier range.
RANGE_ENTRIES = 200_000
#: Identifiers of a range.
RANGE_SIZE = 2**40

_BLOCK = "term string, occurrences long, records long, weight long"
_TERMS = "term_id long, " + _BLOCK


def words_of(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _counted(batch: pd.DataFrame) -> pd.DataFrame:
    """The terms of a batch with their counts."""
    sizes = batch["terms"].map(len).to_numpy(dtype=np.int64)
    record = np.repeat(np.arange(len(batch)), sizes)
    ids, words = pd.factorize(np.concatenate([np.asarray(t, dtype=object) for t in batch["terms"]]))
    n = len(words)
    occurrences = np.bincount(ids, minlength=n)
    seen = np.unique(record * n + ids)
    weights = np.zeros(n, dtype=np.int64)
    np.add.at(weights, seen % n, batch["weight"].to_numpy(dtype=np.int64)[seen // n])
    return pd.DataFrame({"term": words, "occurrences": occurrences, "records": np.bincount(seen % n, minlength=n), "weight": weights})


def _added(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Several blocks as one: terms by a common dictionary, arrays added."""
    if len(parts) == 1:
        return parts[0]
    ids, words = pd.factorize(np.concatenate([p["term"].to_numpy(dtype=object) for p in parts]))
    sums = {}
    for name in ("occurrences", "records", "weight"):
        sums[name] = np.zeros(len(words), dtype=np.int64)
        np.add.at(sums[name], ids, np.concatenate([p[name].to_numpy() for p in parts]))
    return pd.DataFrame({"term": words} | sums)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            parts.append(_counted(batch))
        if sum(map(len, parts)) > BLOCK_TERMS:
            parts = [_added(parts)]
            if len(parts[0]) > BLOCK_TERMS // 2:
                yield parts.pop()
    if parts:
        yield _added(parts)


def _range(group: pd.DataFrame) -> pd.DataFrame:
    ids, words = pd.factorize(group["term"], sort=True)
    sums = {}
    for name in ("occurrences", "records", "weight"):
        sums[name] = np.zeros(len(words), dtype=np.int64)
        np.add.at(sums[name], ids, group[name].to_numpy())
    first = int(group["range"].iloc[0]) * RANGE_SIZE
    return pd.DataFrame({"term_id": first + np.arange(len(words)), "term": words} | sums)


def term_counts(records: DataFrame, terms: Column, weight: Column | None = None) -> DataFrame:
    """term_id, term, occurrences, records, weight: for each distinct term its occurrences, the records that hold it and the sum of their weights.

    records: one row per record. terms: an array column; null terms and records without terms count nothing. A null
    weight is 0. An empty table gives no rows. Identifiers are dense within a range and the same for the same data.
    """
    ready = records.select(
        F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("terms"),
        F.coalesce((weight if weight is not None else F.lit(1)).cast("long"), F.lit(0)).alias("weight"),
    ).where(F.size("terms") > 0)
    entries = cut(ready.mapInPandas(_blocks, _BLOCK))
    ranges = max(1, math.ceil(entries.count() / RANGE_ENTRIES))
    return dealt(entries.withColumn("range", F.pmod(F.xxhash64("term"), F.lit(ranges))), "range").groupBy("range").applyInPandas(_range, _TERMS)


def marked(counts: DataFrame, records: int, support: str, rare_at_most: int = 2, common_above: float = 0.1) -> DataFrame:
    """The counts with a mark: 'common' above a share of all records, else 'rare' up to a support, else null."""
    mark = F.when(F.col("records") > common_above * records, F.lit("common")).when(F.col(support) <= rare_at_most, F.lit("rare"))
    return counts.withColumn("mark", mark)
