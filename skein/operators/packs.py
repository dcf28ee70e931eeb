"""Evidence packs: excerpts chosen greedily under a token budget."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

_ITEM = ["document_id", "chunk_id", "span_start", "span_end", "quote"]


def fill_pack(entries: list[tuple[str, str, list[tuple[int, int, str]]]], count: Callable[[str], int], budget: int, documents: int, prefix: str = "", suffix: str = "") -> list[dict]:
    """entries: (document, chunk, excerpts in order of preference) in rank order. An excerpt that doesn't fit is skipped, a
    later one may still fit; a document without a fitting excerpt takes no place; only a document's first fitting entry counts."""
    if count(prefix + suffix) > budget:
        raise ValueError("the frame alone exceeds the budget")
    chosen: list[dict] = []
    seen: set[str] = set()
    for document, chunk, excerpts in entries:
        if len(seen) >= documents:
            break
        if document in seen:
            continue
        mine: list[dict] = []
        for start, end, quote in excerpts:
            item = dict(zip(_ITEM, (document, chunk, start, end, quote)))
            body = json.dumps([*chosen, *mine, item], ensure_ascii=False, separators=(",", ":"))
            if count(prefix + body + suffix) <= budget:
                mine.append(item)
        if mine:
            chosen += mine
            seen.add(document)
    return chosen


def packs(ranked: DataFrame, query: str, rank: str, count: Callable[[str], int], budget: int = 6000, documents: int = 12) -> DataFrame:
    """query, place and the chosen excerpts of every query. A query's ranked list is bounded by the retrieval limit.

    ranked: query, rank, document_id, chunk_id, excerpts array<struct<start, end, quote>>.
    """
    kind = dict(ranked.dtypes)[query]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([rank, "chunk_id"])
        entries = [(d, c, [(x["start"], x["end"], x["quote"]) for x in e]) for d, c, e in zip(group["document_id"], group["chunk_id"], group["excerpts"])]
        items = fill_pack(entries, count, budget, documents)
        return pd.DataFrame([{query: group[query].iloc[0], "place": i, **item} for i, item in enumerate(items)], columns=[query, "place", *_ITEM])

    return ranked.groupBy(query).applyInPandas(run, f"{query} {kind}, place int, document_id string, chunk_id string, span_start int, span_end int, quote string")
