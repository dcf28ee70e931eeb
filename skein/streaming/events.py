"""Event streams: fixed windows, repeated deliveries, sequences, folds, replay and compaction.

Each operator works on a streaming or a batch DataFrame alike, except where a batch twin is named.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.session import shared_folder


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The event table as a stream of its file, with ts as a time-zoned timestamp, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, keys: str, mode: str = "append") -> DataFrame:
    """Everything a stream gives now, as a table in the shared folder: one run with availableNow, checkpointed there.

    keys names the run. The output is a Parquet table written batch by batch, so it holds what a restarted run would hold.
    """
    spark = stream.sparkSession
    place = shared_folder(spark, keys)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out").drop("batch")


def guarded(spark: SparkSession, place: str, **identity: object) -> str:
    """A folder for the checkpoint of a run with this identity. The first run writes the identity there; a later run that
    resumes with another one, such as other tables or another model, is refused."""
    text = json.dumps(identity, sort_keys=True, separators=(",", ":"), default=str)
    try:
        known = spark.read.text(f"{place}/identity", wholetext=True).first()[0].strip()
    except AnalysisException:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{place}/identity")
        known = text
    if known != text:
        raise ValueError("the checkpoint belongs to a run with another identity")
    return f"{place}/checkpoint"


def tumbling_counts(events: DataFrame, ts: str, key: str, seconds: int, late: str | None = None) -> DataFrame:
    """window_start, key, n: rows of each key in fixed windows. late: how late a row of a stream may come."""
    if late:
        events = events.withWatermark(ts, late)
    counted = events.groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count("*").alias("n"))
    return counted.select(F.unix_seconds("window.start").alias("window_start"), key, "n")


def once(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first delivery of each key; on a stream, state is kept as long as a repeat may come."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


_FOLDED = "key string, last long, seen long, repeated long, gaps long, total double, resets long"


def fold_sequences(events: DataFrame, key: str, sequence: str, value: str, snapshot: str | None = None) -> DataFrame:
    """key, last, seen, repeated, gaps, total, resets: a reducer over numbered events of each key.

    An event is used if its number is above the last one used; the same or a smaller number is a repeat and changes
    nothing; a number further than one above the last is a gap, which is counted and passed. A row marked by the column
    snapshot holds the whole state up to its number: it resets the reader there, so that nothing before it is missed. State
    is a few numbers a key; the rows of a key in one micro-batch are sorted as arrays.
    """

    def reduce(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, repeated, gaps, total, resets = state.get if state.exists else (0, 0, 0, 0, 0.0, 0)
        parts = [(b[sequence].to_numpy(dtype=np.int64), b[value].to_numpy(dtype=np.float64), b[snapshot].to_numpy(dtype=bool) if snapshot else np.zeros(len(b), dtype=bool)) for b in batches]
        numbers, values, marks = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(numbers, kind="stable")
        numbers, values, marks = numbers[order], values[order], marks[order]
        before = np.maximum.accumulate(np.concatenate([[last], numbers]))[:-1]
        new = numbers > before
        used = new & ~marks
        seen, resets, total = seen + int(used.sum()), resets + int((new & marks).sum()), total + float(np.nansum(values[used]))
        repeated, gaps = repeated + int((~new).sum()), gaps + int((used & (numbers > before + 1)).sum())
        last = int(max(last, numbers[-1])) if len(numbers) else last
        state.update((last, seen, repeated, gaps, total, resets))
        yield pd.DataFrame([(str(name[0]), last, seen, repeated, gaps, total, resets)], columns=["key", "last", "seen", "repeated", "gaps", "total", "resets"])

    state = "last long, seen long, repeated long, gaps long, total double, resets long"
    return events.groupBy(key).applyInPandasWithState(reduce, _FOLDED, state, "update", GroupStateTimeout.NoTimeout)


def continuity(events: DataFrame, key: str, sequence: str, payload: Column) -> DataFrame:
    """key, sequence, state of each event of a batch: first, next, repeat (same payload), conflict (other payload) or gap."""
    w = Window.partitionBy(key).orderBy(sequence, payload)
    before, same = F.lag(sequence).over(w), F.lag(payload).over(w)
    n = F.col(sequence)
    state = F.when(before.isNull(), "first").when(n == before, F.when(payload.eqNullSafe(same), "repeat").otherwise("conflict")).when(n == before + 1, "next").otherwise("gap")
    return events.select(key, sequence, state.alias("state"))


def replay(events: DataFrame, key: str, sequence: str, cursors: DataFrame, cursor: str = "cursor") -> DataFrame:
    """key, sequence, kind: what each reader gets: the events behind its cursor, or a snapshot first if events before the
    oldest retained one are gone. A cursor is the last number the reader has."""
    oldest = events.groupBy(key).agg(F.min(sequence).alias("_oldest"))
    readers = cursors.join(oldest, key)
    reset = readers.where(F.col(cursor) < F.col("_oldest") - 1).select(key, (F.col("_oldest") - 1).alias(sequence), F.lit("snapshot").alias("kind"))
    rest = events.join(readers, key).where(F.col(sequence) > F.col(cursor)).select(key, sequence, F.lit("event").alias("kind"))
    return reset.unionByName(rest)


def compacted(events: DataFrame, key: str, at: str, terminal: Column, before) -> DataFrame:
    """Events without those of keys that ended before a moment."""
    ended = events.groupBy(key).agg(F.max(F.when(terminal, F.col(at))).alias("_ended")).where(F.col("_ended") < before)
    return events.join(ended.select(key), key, "left_anti")


def expanded(results: DataFrame, key: str, text: Column) -> DataFrame:
    """key, sequence, kind, payload: a result as numbered events: started, its text in pieces, finished."""
    from skein.functions.text import fixed_pieces

    parts = F.transform(fixed_pieces(text), lambda p: F.struct(F.lit("text").alias("kind"), p.alias("payload")))
    edge = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("payload")))
    return results.select(key, F.posexplode(F.concat(edge("started"), parts, edge("finished"))).alias("i", "e")).select(key, (F.col("i") + 1).alias("sequence"), "e.kind", "e.payload")
