"""Event queries, through Structured Streaming where state is kept, else as the batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.io import table
from skein.plans.registry import Register
from skein.plans.relational import _CHUNKS, chunks, event_sequence
from skein.session import shared_folder
from skein.streaming import events as ev

register = Register()
_HOUR = "epoch_us(time_bucket(INTERVAL '3600 seconds', ts)) // 1000000"


@register(f"SELECT {_HOUR} AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of each kind, from a stream."""
    counted = ev.tumbling_counts(ev.read_events(spark, folder), "ts", "event_type", 3600)
    return ev.drained(counted, "tumbling", "complete")


@register("SELECT DISTINCT user_id, event_type, epoch_us(ts) // 1000000 AS second FROM events")
def dedupe_late(spark: SparkSession, folder: str) -> DataFrame:
    """Events once for each user, kind and second, however often delivered; repeats of a second come within the hour."""
    second = ev.read_events(spark, folder).withColumn("second", F.unix_seconds("ts"))
    return ev.drained(ev.once(second, ["user_id", "event_type", "second"], "ts", "1 hour"), "once").select("user_id", "event_type", "second")


@register("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), k AS (SELECT * FROM n WHERE n % 7 <> 0)
    SELECT user_id::VARCHAR AS key, max(n) AS last, count(*) AS seen, count(*) FILTER (n % 5 = 0) AS repeated, max(n) // 7 AS gaps, round(sum(coalesce(value, 0)), 4) AS total FROM k GROUP BY user_id""")
def sequence_fold(spark: SparkSession, folder: str) -> DataFrame:
    """A reducer over each user's numbered events, with state kept between batches. Every seventh is lost, every fifth comes twice."""
    numbered = event_sequence(spark, folder).join(table(spark, folder, "events").select("event_id", "value"), "event_id").where("sequence_no % 7 <> 0")
    numbered = numbered.unionByName(numbered.where("sequence_no % 5 = 0"))
    place = shared_folder(spark, "numbered")
    numbered.write.parquet(f"{place}/rows")
    stream = spark.readStream.schema(numbered.schema).parquet(f"{place}/rows")
    return ev.drained(ev.fold_sequences(stream, "user_id", "sequence_no", "value"), "fold", "update").select("key", "last", "seen", "repeated", "gaps", F.round("total", 4).alias("total"))


@register("WITH d AS (SELECT user_id, event_id, value, epoch_us(ts) // 60000000 AS minute FROM events), s AS (SELECT user_id, minute, value, lag(minute) OVER w AS b, lag(round(value, 0)) OVER w AS v FROM d WINDOW w AS (PARTITION BY user_id ORDER BY minute, round(value, 0))) SELECT CASE WHEN b IS NULL THEN 'first' WHEN minute = b AND round(value, 0) IS NOT DISTINCT FROM v THEN 'repeat' WHEN minute = b THEN 'conflict' WHEN minute = b + 1 THEN 'next' ELSE 'gap' END AS state, count(*) AS n FROM s GROUP BY 1")
def continuity_states(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("minute"), F.round("value", 0).alias("v"))
    return ev.continuity(e, "user_id", "minute", F.col("v")).groupBy("state").agg(F.count("*").alias("n"))


_SEQ = "s AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_no FROM events), k AS (SELECT * FROM s WHERE sequence_no > 3)"


@register(f"WITH {_SEQ}, c AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 5 END AS cursor FROM (SELECT DISTINCT user_id FROM events)), o AS (SELECT user_id, min(sequence_no) AS oldest FROM k GROUP BY 1) SELECT user_id, kind, count(*) AS n, min(sequence_no) AS first FROM (SELECT k.user_id, k.sequence_no, 'event' AS kind FROM k JOIN c USING (user_id) WHERE sequence_no > cursor UNION ALL SELECT user_id, oldest - 1, 'snapshot' FROM c JOIN o USING (user_id) WHERE cursor < oldest - 1) GROUP BY ALL")
def replay_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Readers at two cursors over a log whose first three events of each user are gone."""
    kept = event_sequence(spark, folder).where("sequence_no > 3")
    cursors = table(spark, folder, "events").select("user_id").distinct().withColumn("cursor", F.when(F.col("user_id") % 2 == 0, 1).otherwise(5))
    got = ev.replay(kept, "user_id", "sequence_no", cursors)
    return got.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.min("sequence_no").alias("first"))


@register("WITH x AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS ended FROM events GROUP BY 1) SELECT e.event_id, e.user_id FROM events e JOIN x USING (user_id) WHERE ended IS NULL OR ended >= TIMESTAMP '2024-01-25'")
def retention_compact(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return ev.compacted(e, "user_id", "ts", F.col("event_type") == "purchase", F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id", "user_id")


@register(f"WITH {_CHUNKS} SELECT chunk_id, 2 + (length(text) + 1023) // 1024 AS events, length(text) AS characters FROM chunks")
def result_events(spark: SparkSession, folder: str) -> DataFrame:
    e = ev.expanded(chunks(spark, folder), "chunk_id", F.col("text"))
    return e.groupBy("chunk_id").agg(F.count("*").alias("events"), F.sum(F.char_length("payload")).alias("characters"))


QUERIES, ORACLE = register.queries, register.sql
