from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from skein.streaming import events as ev


def stream_of(spark, tmp_path, rows, schema, files=3):
    df = spark.createDataFrame(rows, schema)
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows_count_rejected_and_late_rows_alike(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(seconds=s), k) for s, k in ((0, "a"), (59, "a"), (60, "a"), (61, "b"), (3, "a"))]
    s = stream_of(spark, tmp_path, rows, "ts timestamp, k string")
    got = {(r.window_start - 1704067200, r.k): r.n for r in ev.drained(ev.tumbling_counts(s, "ts", "k", 60), "t", "complete").groupBy("window_start", "k").agg(F.max("n").alias("n")).collect()}
    assert got == {(0, "a"): 3, (60, "a"): 1, (60, "b"): 1}


def test_repeats_are_dropped_over_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t, "a"), (t, "a"), (t + timedelta(minutes=1), "a"), (t, "b")]
    s = stream_of(spark, tmp_path, rows, "ts timestamp, k string")
    assert sorted(r.k for r in ev.drained(ev.once(s, ["k"], "ts", "1 hour"), "o").collect()) == ["a", "b"]
    assert ev.once(spark.createDataFrame(rows, "ts timestamp, k string"), ["k"], "ts", "1 hour").count() == 2


def test_fold_ignores_repeats_and_counts_gaps(spark, tmp_path):
    rows = [("u", 1, 1.0), ("u", 2, 2.0), ("u", 2, 9.0), ("u", 5, 4.0), ("v", 1, None), ("u", 4, 8.0)]
    spark.createDataFrame(rows, "k string, n long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, n long, v double").parquet(str(tmp_path / "in"))
    got = {r.key: r for r in ev.drained(ev.fold_sequences(s, "k", "n", "v"), "f", "update").collect()}
    u, v = got["u"], got["v"]
    assert (u.last, u.seen, u.repeated, u.gaps, u.total) == (5, 4, 1, 1, 15.0) and (v.seen, v.total) == (1, 0.0)


def test_continuity_replay_and_compaction(spark):
    e = spark.createDataFrame([("r", 4, "x"), ("r", 5, "y"), ("r", 5, "y"), ("r", 5, "z"), ("r", 9, "w")], "k string, n int, p string")
    assert sorted((r.n, r.state) for r in ev.continuity(e, "k", "n", F.col("p")).collect()) == [(4, "first"), (5, "conflict"), (5, "next"), (5, "repeat"), (9, "gap")]
    log = e.dropDuplicates(["n"])
    cursors = spark.createDataFrame([("r", 1), ("q", 0)], "k string, cursor int")
    assert sorted((r.n, r.kind) for r in ev.replay(log, "k", "n", cursors).collect()) == [(3, "snapshot"), (4, "event"), (5, "event"), (9, "event")]
    assert sorted(r.n for r in ev.replay(log, "k", "n", spark.createDataFrame([("r", 4)], "k string, cursor int")).collect()) == [5, 9]
    kept = ev.compacted(spark.createDataFrame([("a", 1, "end"), ("a", 2, "x"), ("b", 1, "x"), ("c", 9, "end")], "k string, at int, p string"), "k", "at", F.col("p") == "end", 5)
    assert sorted({r.k for r in kept.collect()}) == ["b", "c"]


def test_results_expand_to_numbered_events(spark):
    got = ev.expanded(spark.createDataFrame([("a", "x" * 1500), ("b", "")], "k string, t string"), "k", F.col("t")).toPandas()
    a = got[got["k"] == "a"].sort_values("sequence")
    assert a["kind"].tolist() == ["started", "text", "text", "finished"] and a["payload"].map(len).tolist() == [0, 1024, 476, 0]
    assert isinstance(got, pd.DataFrame) and len(got[got["k"] == "b"]) == 2


def test_a_checkpoint_is_bound_to_its_run(spark, tmp_path):
    import pytest

    place = str(tmp_path / "run")
    first = ev.guarded(spark, place, table="events", model="é", size=3)
    assert first == ev.guarded(spark, place, size=3, model="é", table="events")
    with pytest.raises(ValueError):
        ev.guarded(spark, place, table="events", model="b", size=3)
