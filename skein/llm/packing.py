"""Filling fixed-capacity containers with items.

Method: vector bin packing with the dot-product heuristic. An item demands tokens, one segment and loss-bearing tokens; a
container has a limit on each. The open container takes, of the items that still fit in every dimension, the one whose
demand has the largest dot product with what is left of the capacity, each dimension scaled by its limit and weighted by
how scarce it is; when none fits it is closed. Items with equal demands are one class, so a step looks at classes, of which
there are at most as many as the token limit.

Items are dealt by hash into shards of about SHARD_ITEMS, which are packed independently. Containers that a shard leaves
less full than a share in every dimension are opened again, and their items are dealt anew and packed together, until one
shard holds them all or packing again saves no more than SAVED of the containers; so the loss by sharding vanishes and no
task grows with the data. An item above the token limit or the loss limit is cut where it reaches either; its rest is an item
like any other; nothing else is split.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut, dealt, spread

#: Items of a shard on average.
SHARD_ITEMS = 6_000
#: A container that reaches this share of one of its limits stays closed.
FULL_ENOUGH = 0.97
#: Packing open containers again goes on while it saves more than this share of them.
SAVED = 0.01


class Tokenizer:
    """A byte-level BPE tokenizer read from a public rank file (base64 token and rank on each line), loaded once in a process."""

    loaded: dict[str, object] = {}

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def counts(self, texts: list[str]) -> list[int]:
        if self.path not in self.loaded:
            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.loaded[self.path] = tiktoken.Encoding("public", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        encode = self.loaded[self.path].encode_ordinary
        return [len(encode(t)) for t in texts]


def token_counts(documents: DataFrame, key: str, text: str | list[str], tokenizer: Tokenizer) -> DataFrame:
    """key and the length of every text in tokens: for one column as tokens, for several under the columns' names.

    Rows without a key or a text are left out, an empty text has 0 tokens.
    """
    kind = dict(documents.dtypes)[key]
    columns = [text] if isinstance(text, str) else text
    names = ["tokens"] if isinstance(text, str) else text
    known = F.col(key).isNotNull()
    for c in columns:
        known &= F.col(c).isNotNull()
    ready = spread(documents.where(known).select(F.col(key).alias("k"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(columns)]), "k")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"]} | {f"n{i}": tokenizer.counts(batch[f"t{i}"].tolist()) for i in range(len(columns))})

    counted = ready.mapInPandas(count, f"k {kind}, " + ", ".join(f"n{i} int" for i in range(len(columns))))
    return counted.select(F.col("k").alias(key), *[F.col(f"n{i}").alias(n) for i, n in enumerate(names)])


def dot_product_packing(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """demands: items by dimensions, each within the limits. Returns the container (0, 1, ...) of each item."""
    if not len(demands):
        return np.zeros(0, dtype=np.int64)
    classes, of = np.unique(demands, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    left = np.bincount(of.ravel(), minlength=len(classes))
    begin = np.concatenate([[0], np.cumsum(left)[:-1]])
    scaled = classes / limits
    out = np.empty(len(demands), dtype=np.int64)
    # scarce dimensions count more: total demand over all items in units of the limit
    weights = (scaled * left[:, None]).sum(axis=0)
    weights = weights / weights.max()
    value = scaled * weights / limits  # dot product with the room left, up to that room
    columns = [np.ascontiguousarray(classes[:, d]) for d in range(classes.shape[1])]
    gains = [np.ascontiguousarray(value[:, d]) for d in range(classes.shape[1])]
    container, room, full = 0, limits.astype(np.float64), limits.astype(np.float64)
    gone = 0
    for _ in range(len(demands)):
        while True:
            score = gains[0] * room[0]
            fits = columns[0] <= room[0]
            for d in range(1, len(columns)):
                score += gains[d] * room[d]
                fits &= columns[d] <= room[d]
            score[~fits] = -1.0
            c = int(score.argmax())
            if score[c] >= 0.0:
                break
            container, room = container + 1, full
        out[order[begin[c]]] = container
        begin[c] += 1
        left[c] -= 1
        room = room - classes[c]
        if not left[c]:
            # a class without items fits nowhere; now and then such classes are taken out
            columns[0][c] = limits[0] + 1
            gone += 1
            if 4 * gone > len(columns[0]):
                kept = np.flatnonzero(left)
                classes, left, begin, gone = classes[kept], left[kept], begin[kept], 0
                columns, gains = [x[kept] for x in columns], [x[kept] for x in gains]
    return out


def pack(items: DataFrame, key: str, tokens: str, loss_tokens: str, capacity: int = 2048, segments: int = 64, loss_capacity: int | None = None) -> DataFrame:
    """container, key, part, token_start, tokens, loss_tokens: every item in containers within all three limits.

    container is a string that names shard and number. An item of more than capacity tokens or more than loss_capacity
    (by default the capacity) loss-bearing tokens is cut into parts where either limit is reached; the parts of full
    capacity have containers of their own. The loss-bearing tokens of an item are its last ones, and are shared among
    parts in the order of their tokens. Items of 0 tokens take a segment only. Null lengths count
    as 0; null keys are left out; repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    loss_capacity = capacity if loss_capacity is None else loss_capacity
    if loss_capacity < 1:
        raise ValueError("the loss limit must let a loss-bearing token in")
    n = F.coalesce(F.col(tokens).cast("int"), F.lit(0))
    # loss-bearing tokens are the last ones of an item
    loss = F.least(F.coalesce(F.col(loss_tokens).cast("int"), F.lit(0)), n)
    lengths = items.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), n.alias("n"), loss.alias("l"))
    # full parts up to the one in which the loss-bearing tokens begin, then parts of as many as both limits allow
    step, free = min(capacity, loss_capacity), F.col("n") - F.greatest(F.lit(0), F.col("l"))
    begun = F.greatest(F.lit(0), F.least(F.floor(free / capacity), F.ceil(F.col("n") / capacity) - 1)).cast("int")
    lengths = lengths.withColumn("begun", begun).withColumn("begun_end", F.least(F.col("n"), (F.col("begun") + 1) * capacity, free + step))
    rests = F.ceil((F.col("n") - F.col("begun_end")) / step).cast("int")
    parts = lengths.select("k", "n", "l", "begun", "begun_end", F.posexplode(F.sequence(F.lit(0), F.col("begun") + rests)).alias("part", "_"))
    later = F.col("part") - F.col("begun")
    token_start = F.when(later <= 0, F.col("part") * capacity).otherwise(F.col("begun_end") + (later - 1) * step)
    token_end = F.when(later < 0, (F.col("part") + 1) * capacity).when(later == 0, F.col("begun_end")).otherwise(F.least(F.col("n"), F.col("begun_end") + later * step))
    parts = parts.select("k", "part", token_start.alias("token_start"), token_end.alias("token_end"), "n", "l")
    size = F.col("token_end") - F.col("token_start")
    first_loss = F.greatest(F.col("n") - F.col("l"), F.col("token_start"))
    parts = parts.select("k", "part", "token_start", size.alias("tokens"), F.greatest(F.lit(0), F.col("token_end") - first_loss).alias("loss_tokens"))
    open_parts = cut(parts)
    kind = dict(open_parts.dtypes)["k"]
    schema = f"container string, k {kind}, part int, token_start int, tokens int, loss_tokens int, full boolean"
    limits = np.array([capacity, segments, loss_capacity])

    def packer(label: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["k", "part", "tokens"], kind="stable")
            demands = np.stack([group["tokens"], np.ones(len(group), dtype=np.int64), group["loss_tokens"]], axis=1)
            at = dot_product_packing(demands, limits)
            used = np.stack([np.bincount(at, weights=demands[:, d]) for d in range(demands.shape[1])], axis=1)
            full = (used >= FULL_ENOUGH * limits).any(axis=1)[at]
            shard = int(group["shard"].iloc[0])
            return group[["k", "part", "token_start", "tokens", "loss_tokens"]].assign(container=[f"{label}-{shard}-{c}" for c in at], full=full)

        return run

    closed, level, before, count = [], 0, None, open_parts.count()
    while True:
        shards = max(1, math.ceil(count / SHARD_ITEMS))
        sharded = dealt(open_parts.withColumn("shard", F.pmod(F.xxhash64("k", "part", F.lit(level)), F.lit(shards))), "shard")
        packed = sharded.groupBy("shard").applyInPandas(packer(str(level)), schema)
        if shards == 1:
            closed.append(packed)
            break
        packed, open_ = cut(packed), ~F.col("full")
        now = packed.agg(F.count_distinct("container").alias("all"), F.count_distinct(F.when(open_, F.col("container"))).alias("open"), F.count_if(open_).alias("items")).first()
        if not now["items"] or (before is not None and now["all"] > (1 - SAVED) * before):
            closed.append(packed)
            break
        closed.append(packed.where("full"))
        open_parts, level = packed.where(open_).select("k", "part", "token_start", "tokens", "loss_tokens"), level + 1
        before, count = now["open"], now["items"]
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out.select("container", F.col("k").alias(key), "part", "token_start", "tokens", "loss_tokens")


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, items, tokens, fill: how many containers there are and what share of their tokens is used."""
    each = packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * capacity)).alias("fill"))
