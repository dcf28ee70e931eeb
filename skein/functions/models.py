"""Model calls as injected functions over Arrow batches, and deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import term_list


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], size: int):
    """A column function text -> vector. load runs once in a worker and gives the function; a vector of another size or with
    values that aren't finite is an error. Null texts have no vector."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            known = texts.notna()
            vectors = model(texts[known].tolist()) if known.any() else []
            for v in vectors:
                if len(v) != size or not np.isfinite(v).all():
                    raise ValueError("the model gave a wrong vector")
            out = pd.Series([None] * len(texts), dtype=object)
            out[known.to_numpy()] = pd.Series([list(map(float, v)) for v in vectors], dtype=object).to_numpy()
            yield out

    return F.pandas_udf(embed, T.ArrayType(T.DoubleType()))


def hashed_terms(size: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A stand-in model: signed hashed term counts, normalized."""

    def load():
        def run(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), size))
            for i, text in enumerate(texts):
                for term in term_list(text):
                    h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                    out[i, h % size] += 1.0 if h >> 32 & 1 else -1.0
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(norm > 0, norm, 1.0)).tolist()

        return run

    return load


def scorer(load: Callable[[], Callable[[str, list[str]], list[float]]], query: str):
    """A column function text -> score against a query; a score that isn't finite is an error."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            got = np.asarray(model(query, texts.fillna("").tolist()), dtype=float)
            if len(got) != len(texts) or not np.isfinite(got).all():
                raise ValueError("the model gave wrong scores")
            yield pd.Series(got)

    return F.pandas_udf(score, T.DoubleType())


def labelled(rows: DataFrame, load: Callable[[], Callable[[list[tuple]], list[str]]], columns: list[str], name: str = "label") -> DataFrame:
    """rows with a label given by an injected classifier over some columns, batch by batch."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(**{name: model(list(batch[columns].itertuples(index=False, name=None)))})

    return rows.mapInPandas(classify, schema)


def expanded_queries(query: str, features: list[tuple[str, float]], most: int = 8) -> list[str]:
    """The query and the texts of its weightiest features, each once whatever its letter case, at most `most` features."""
    out, seen = [], set()
    ordered = [t for t, _ in sorted(features, key=lambda f: (-f[1], f[0]))]
    for text in [query, *ordered]:
        text = " ".join(text.split())
        if text and text.casefold() not in seen and len(out) <= most:
            seen.add(text.casefold())
            out.append(text)
    return out
