"""References to records that do not exist.

Every reference is judged at one moment, the first delivery of the record that holds it. The target is live at that
moment if a copy of it had been delivered and no copy was deleted by then.

Method. Keys of references and targets fall into key ranges by hash; inside a range the sorted distinct keys are a
dictionary that turns a key into a dense integer. For each period (month) and referring field a compressed bitmap holds
the referenced integers, and another holds the targets live throughout that period. Reference AND-NOT parent leaves the
bits that may be orphans, which are decoded to keys. A target that came or went within the period is in no parent bitmap,
so its references survive too; the exact moments then decide over the survivors only.

A hot key is one bit of a bitmap however many records refer to it; records meet only the surviving keys, in a join that
adaptive execution may split. Ranges hold about RANGE_KEYS keys, so no task grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.bitmaps import Bitmap

#: Distinct keys that a key range holds on average.
RANGE_KEYS = 40_000

_FIELD_SCHEMA = "field int, period int, key binary, first_seen timestamp_ntz, gone timestamp_ntz"


@dataclass(frozen=True)
class Reference:
    """A field of a referring table and the table its keys belong to."""

    field: str
    target: str


def key_bytes(key: Column) -> Column:
    """One binary form for all spellings of a UUID (case, braces, urn prefix, hyphens, outer blanks); other keys are trimmed."""
    bare = F.regexp_replace(F.lower(key), r"^\s*urn:uuid:|[-{}\s]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.unhex(bare)).when(key.isNotNull(), F.encode(F.trim(key), "UTF-8"))


def month_number(moment: Column) -> Column:
    return F.year(moment) * 12 + F.month(moment) - 1


def lifetimes(targets: DataFrame, key: str, received: str = "received_at", deleted: str = "deleted_at") -> DataFrame:
    """key, first_seen, gone: one row for each target key. Rows without a key or a delivery time are no targets."""
    return (
        targets.select(key_bytes(F.col(key)).alias("key"), F.col(received).cast("timestamp_ntz").alias("r"), F.col(deleted).cast("timestamp_ntz").alias("d"))
        .where("key is not null and r is not null")
        .groupBy("key")
        .agg(F.min("r").alias("first_seen"), F.min("d").alias("gone"))
    )


def judged_references(records: DataFrame, record_id: str, fields: list[str], received: str = "received_at") -> DataFrame:
    """record_id, moment, field (position in fields), key: every distinct non-null reference of a record."""
    refs = F.filter(
        F.array(*[F.struct(F.lit(i).alias("field"), key_bytes(F.col(f)).alias("key")) for i, f in enumerate(fields)]),
        lambda r: r["key"].isNotNull(),
    )
    return (
        records.select(F.col(record_id).alias("record_id"), F.col(received).cast("timestamp_ntz").alias("t"), refs.alias("refs"))
        .where("record_id is not null and t is not null")
        .groupBy("record_id")
        .agg(F.min("t").alias("moment"), F.collect_set("refs").alias("refs"))
        .select("record_id", "moment", F.explode(F.array_distinct(F.flatten("refs"))).alias("ref"))
        .select("record_id", "moment", F.col("ref.field").alias("field"), F.col("ref.key").alias("key"))
    )


def _surviving_bits(group: pd.DataFrame) -> pd.DataFrame:
    """One key range: dictionary, bitmaps per field and period, AND-NOT, decode."""
    ids, words = pd.factorize(group["key"], sort=True)
    is_parent = group["field"].to_numpy() < 0
    parent_ids = ids[is_parent]
    live_from, live_to = group["period"].to_numpy()[is_parent], group["live_to"].to_numpy()[is_parent]
    seen = np.full(len(words), np.datetime64("NaT"), dtype="datetime64[us]")
    gone = seen.copy()
    seen[parent_ids] = group["first_seen"].to_numpy().astype("datetime64[us]")[is_parent]
    gone[parent_ids] = group["gone"].to_numpy().astype("datetime64[us]")[is_parent]
    refs = group.loc[~is_parent, ["field", "period"]].assign(id=ids[~is_parent])
    parents: dict[int, Bitmap] = {}
    out = []
    for (field, period), part in refs.groupby(["field", "period"], sort=False):
        if period not in parents:
            parents[period] = Bitmap.of(parent_ids[(live_from <= period) & (period < live_to)])
        left = Bitmap.of(part["id"].to_numpy()).andnot(parents[period]).ids()
        if len(left):
            out.append(pd.DataFrame({"field": np.int32(field), "period": np.int32(period), "key": np.asarray(words, dtype=object)[left], "first_seen": seen[left], "gone": gone[left]}))
    if not out:
        return pd.DataFrame({"field": pd.Series(dtype="int32"), "period": pd.Series(dtype="int32"), "key": pd.Series(dtype=object), "first_seen": pd.Series(dtype="datetime64[us]"), "gone": pd.Series(dtype="datetime64[us]")})
    return pd.concat(out, ignore_index=True)


def orphan_references(references: DataFrame, targets: DataFrame, ranges: int) -> DataFrame:
    """record_id, field, period: references (of judged_references) without a live target (of lifetimes).

    Empty inputs give no rows; without targets every reference is an orphan.
    """
    refs = references.withColumn("period", month_number(F.col("moment")))
    month_start = F.date_trunc("month", F.col("first_seen")).cast("timestamp_ntz")
    parents = targets.select(
        F.lit(-1).alias("field"),
        (month_number(F.col("first_seen")) + (F.col("first_seen") > month_start).cast("int")).alias("period"),
        "key",
        F.coalesce(month_number(F.col("gone")), F.lit(2**31 - 1)).alias("live_to"),
        "first_seen",
        "gone",
    )
    used = refs.select("field", "period", "key").distinct()
    nothing = F.lit(None).cast("timestamp_ntz")
    both = parents.unionByName(used.select("field", "period", "key", F.lit(0).alias("live_to"), nothing.alias("first_seen"), nothing.alias("gone")))
    survivors = (
        both.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges))).groupBy("range").applyInPandas(_surviving_bits, _FIELD_SCHEMA)
    )
    live = (F.col("first_seen") <= F.col("moment")) & (F.col("gone").isNull() | (F.col("gone") > F.col("moment")))
    return refs.join(survivors, ["field", "period", "key"]).where(~F.coalesce(live, F.lit(False))).select("record_id", "field", "period")


def orphans_of_table(records: DataFrame, record_table: str, record_id: str, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """record_table, field_name, record_id, period: orphans of one table.

    references: the field, the table it points into and that table's key. Fields that point into the same table share one
    pass over the bitmaps.
    """
    out = None
    by_target: dict[int, list[tuple[str, DataFrame, str]]] = {}
    for ref in references:
        by_target.setdefault(id(ref[1]), []).append(ref)
    for refs in by_target.values():
        fields, target, key = [r[0] for r in refs], refs[0][1], refs[0][2]
        ranges = max(1, -(-(records.count() + target.count()) // RANGE_KEYS))
        found = orphan_references(judged_references(records, record_id, fields), lifetimes(target, key), ranges)
        names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
        year, month = F.floor(F.col("period") / 12), F.col("period") % 12 + 1
        rows = found.select(
            F.lit(record_table).alias("record_table"), names.alias("field_name"), "record_id", F.format_string("%04d-%02d", year.cast("int"), month.cast("int")).alias("period")
        ).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """record_table, field_name, period, orphans: how many references of each table, field and month have no target."""
    return orphans.groupBy("record_table", "field_name", "period").agg(F.count("*").alias("orphans"))
