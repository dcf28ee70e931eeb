"""Lexical scores of texts against a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import term_list

K1, B = 1.2, 0.75


def bm25(documents: DataFrame, terms: Column, query: str) -> DataFrame:
    """The rows with their BM25 score; rows that hold no query term score 0. See bm25_all."""
    return bm25_all(documents, terms, [query]).withColumn("score", F.get("scores", F.lit(0))).drop("scores")


def bm25_all(documents: DataFrame, terms: Column, queries: list[str]) -> DataFrame:
    """The rows with an array of their BM25 scores for several queries, from one scan for the totals and one for the scores.

    Repeated query terms count repeatedly; frequencies, lengths and document frequencies are those of the rows given. Only
    counts of the queries' terms leave a row, so the one aggregation has a single row and nothing is shuffled by term.
    """
    wanted = [term_list(q) for q in queries]
    distinct = sorted({w for q in wanted for w in q})
    known = F.array(*[F.lit(w) for w in distinct])
    # a row keeps the terms of the queries only, and each is counted in these few
    kept = F.filter("_terms", lambda t: F.array_contains(known, t))
    rows = documents.withColumn("_terms", terms).select(*documents.columns, F.size("_terms").alias("_length"), kept.alias("_kept"))
    occurrences = lambda w: F.size(F.filter("_kept", lambda t: t == F.lit(w)))
    counts = [occurrences(w).alias(f"_f{i}") for i, w in enumerate(distinct)]
    rows = rows.select(*documents.columns, "_length", *counts)
    totals = rows.agg(F.count("*").alias("n"), F.avg("_length").alias("length"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(distinct))]).first()
    n, average = totals["n"], totals["length"] or 1.0
    parts = []
    for i, _ in enumerate(distinct):
        idf = F.log(F.lit(1 + (n - totals[f"d{i}"] + 0.5) / (totals[f"d{i}"] + 0.5)))
        f = F.col(f"_f{i}")
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_length") / average)))
    scores = []
    for q in wanted:
        score = F.lit(0.0)
        for w in q:
            score = score + parts[distinct.index(w)]
        scores.append(score)
    return rows.withColumn("scores", F.array(*scores)).drop("_length", *[f"_f{i}" for i in range(len(distinct))])


def overlap_score(query_terms: Column, terms: Column) -> Column:
    """Shared distinct terms by the root of the length."""
    return F.size(F.array_intersect(query_terms, terms)) / F.sqrt(F.greatest(F.lit(1), F.size(terms)))
