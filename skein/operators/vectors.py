"""Vectors: exact nearest neighbours of a query set, pooling, medoids and similarity histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut, dealt, spread

#: Query vectors that go to every task in one pass.
QUERY_BLOCK = 4096


def unit(vector: Column) -> Column:
    """A vector of doubles of length 1; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def _blocks_of(queries: DataFrame) -> int:
    return max(1, -(-queries.count() // QUERY_BLOCK))


def _query_blocks(queries: DataFrame, blocks: int, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most about QUERY_BLOCK queries, one at a time."""
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = part.select(F.col(key).alias("k"), F.col(vector).alias("v")).toPandas()
        if len(rows):
            yield rows["k"].to_numpy(), _matrix(rows["v"])


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, floor: float = -1.0) -> DataFrame:
    """query_id, neighbour_id, similarity, rank: the k rows of base most similar to each query, itself left out.

    Exact cosine, clamped to [-1, 1]; ties go to the smaller neighbour. Queries are taken in blocks; each task compares a
    block with its rows and keeps k for each query, so only those candidates are shuffled. The result of a block is written
    before the next begins, so that the driver never holds more than one. Rows without a vector are left out.
    """
    kind = dict(base.dtypes)[key]
    schema = f"query_id {kind}, neighbour_id {kind}, similarity double"
    rows = spread(base.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")), "k")
    queries = queries.where(F.col(vector).isNotNull())
    out, blocks = None, _blocks_of(queries)
    for ids, matrix in _query_blocks(queries, blocks, key, vector):

        def compare(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                names = batch["k"].to_numpy()
                s = np.round(np.clip(matrix @ _matrix(batch["v"]).T, -1, 1), 9)
                s[ids[:, None] == names[None, :]] = -2.0
                take = min(k, len(names))
                order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :take]
                q, c = np.repeat(np.arange(len(ids)), take), order.ravel()
                keep = s[q, c] >= floor
                yield pd.DataFrame({"query_id": ids[q[keep]], "neighbour_id": names[c[keep]], "similarity": s[q[keep], c[keep]]})

        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour_id").alias("n")))), 1, k)
        top = rows.mapInPandas(compare, schema).groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("i", "x"))
        part = top.select("query_id", F.col("x.n").alias("neighbour_id"), (-F.col("x.s")).alias("similarity"), (F.col("i") + 1).alias("rank"))
        part = part if blocks == 1 else cut(part)
        out = part if out is None else out.unionByName(part)
    return base.sparkSession.createDataFrame([], schema + ", rank int") if out is None else out


def similarity_histogram(base: DataFrame, queries: DataFrame, key: str, vector: str, bins: int = 20) -> DataFrame:
    """bin, pairs: how many (query, row) pairs have a cosine in each half-open bin of [-1, 1]; no pair leaves its task."""
    rows = spread(base.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")), "k")
    queries = queries.where(F.col(vector).isNotNull())
    out, blocks = None, _blocks_of(queries)
    for ids, matrix in _query_blocks(queries, blocks, key, vector):

        def count(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                s = np.round(matrix @ _matrix(batch["v"]).T, 9)
                other = ids[:, None] != batch["k"].to_numpy()[None, :]
                at = np.clip(np.floor((s[other] + 1) * bins / 2).astype(int), 0, bins - 1)
                n = np.bincount(at, minlength=bins)
                yield pd.DataFrame({"bin": np.arange(bins), "pairs": n})[n > 0]

        part = rows.mapInPandas(count, "bin long, pairs long").groupBy("bin").agg(F.sum("pairs").alias("pairs"))
        part = part if blocks == 1 else cut(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return base.sparkSession.createDataFrame([], "bin long, pairs long")
    return out.groupBy("bin").agg(F.sum("pairs").alias("pairs"))


def _means(rows: DataFrame, group: str, vector: str, weight: Column | None = None) -> DataFrame:
    """_g, _mean: the (weighted) mean of the unit vectors of each group.

    A task adds up the vectors of a group in one array for each Arrow batch, so a hot group is one array a batch; these are
    dealt by group and added again. Rows without a group or vector count nothing.
    """
    kind = dict(rows.dtypes)[group]
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    ready = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("_g"), F.coalesce(w, F.lit(0.0)).alias("w"), F.col(vector).alias("v"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            codes, names = pd.factorize(batch["_g"])
            weights = batch["w"].to_numpy()
            sums = np.zeros((len(names), len(batch["v"].iloc[0])))
            np.add.at(sums, codes, _matrix(batch["v"]) * weights[:, None])
            yield pd.DataFrame({"_g": names, "s": list(sums), "w": np.bincount(codes, weights)})

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        total = parts["w"].sum()
        mean = np.stack(parts["s"].to_list()).sum(axis=0) / (total if total else 1.0)
        return pd.DataFrame({"_g": parts["_g"].iloc[:1], "_mean": [mean]})

    parts = ready.mapInPandas(add, f"_g {kind}, s array<double>, w double")
    return dealt(parts, "_g").groupBy("_g").applyInPandas(finish, f"_g {kind}, _mean array<double>")


def pooled(rows: DataFrame, group: str, vector: str, weight: Column | None = None) -> DataFrame:
    """group, position, value: the (weighted) mean of the unit vectors of each group, brought to unit length."""
    means = _means(rows, group, vector, weight)
    return means.select(F.col("_g").alias(group), F.posexplode(unit(F.col("_mean"))).alias("position", "value"))


def medoids(members: DataFrame, cluster: str, member: str, vector: str, *ties: Column) -> DataFrame:
    """cluster, member, similarity: the member with the largest mean cosine to all members, itself included.

    The mean cosine is the dot product with the mean of the unit vectors, so no pair of members is formed. Ties are broken
    by the given columns, then by the member.
    """
    ready = members.select(cluster, member, unit(F.col(vector)).alias("_u"), *[t.alias(f"_t{i}") for i, t in enumerate(ties)])
    centre = _means(members, cluster, vector).select(F.col("_g").alias(cluster), F.col("_mean").alias("_c"))
    scored = ready.join(centre, cluster).withColumn("similarity", F.round(dot(F.col("_u"), F.col("_c")), 9))
    order = F.struct(-F.col("similarity"), *[F.col(f"_t{i}") for i in range(len(ties))], F.col(member))
    return scored.groupBy(cluster).agg(F.min_by(F.struct(member, "similarity"), order).alias("b")).select(cluster, "b.*")
