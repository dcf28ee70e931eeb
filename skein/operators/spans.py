"""Joins and checks over half-open code-point spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlapping(left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Rows of both sides on the same text whose spans overlap; the equality is the join key, the spans are a residual."""
    return left.join(right, on).where((F.col(left_span[0]) < F.col(right_span[1])) & (F.col(left_span[1]) > F.col(right_span[0])))


def contained(inner: DataFrame, outer: DataFrame, on: str, inner_span: tuple[str, str], outer_span: tuple[str, str]) -> DataFrame:
    """Rows of inner that lie within some span of outer on the same text."""
    i, o = inner.alias("i"), outer.select(on, *[F.col(c).alias(f"_{c}") for c in outer_span]).alias("o")
    within = (F.col(f"i.{on}") == F.col(f"o.{on}")) & (F.col(f"o._{outer_span[0]}") <= F.col(f"i.{inner_span[0]}")) & (F.col(f"i.{inner_span[1]}") <= F.col(f"o._{outer_span[1]}"))
    return i.join(o, within, "left_semi")


def sane(start: Column, end: Column, text: Column) -> Column:
    """Whether a span is a non-empty part of a text."""
    return F.coalesce((start >= 0) & (start < end) & (end <= F.char_length(text)), F.lit(False))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def _occurrences(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """Overlapping occurrences of a quote in a text; -1 marks nulls."""
    return pd.Series([len(re.findall(f"(?={re.escape(q)})", t)) if isinstance(t, str) and isinstance(q, str) and q else (0 if isinstance(t, str) and isinstance(q, str) else None) for t, q in zip(texts, quotes)], dtype="Int64")


occurrences = F.pandas_udf(_occurrences, T.LongType())


def uncovered(texts: DataFrame, key: str, text: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    """key, gap_start, gap_end: parts of each text that no span covers and that hold more than white space.

    The spans of one text are in order; a gap lies between the largest end so far and the next start.
    """
    real = spans.select(key, F.col(start).alias("s"), F.col(end).alias("e")).where("s < e")
    bounds = real.unionByName(texts.select(key, F.char_length(text).alias("s"), F.char_length(text).alias("e")))
    w = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = bounds.withColumn("reach", F.coalesce(F.max("e").over(w), F.lit(0))).where("s > reach").select(key, F.col("reach").alias("gap_start"), F.col("s").alias("gap_end")).distinct()
    return gaps.join(texts.select(key, F.col(text).alias("_t")), key).where(F.trim(F.regexp_replace(slice_of(F.col("_t"), F.col("gap_start"), F.col("gap_end")), r"\s+", "")) != "").drop("_t")
