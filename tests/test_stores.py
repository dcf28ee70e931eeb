import json

import pytest

from skein.functions import models
from skein.sources import stores


def test_versions_upserts_and_removals(spark, tmp_path):
    path = stores.store_path(str(tmp_path), model="m", size=2)
    assert path != stores.store_path(str(tmp_path), model="m", size=3) and path == stores.store_path(str(tmp_path), size=2, model="m")
    schema = "id string, revision_id string, v array<double>"
    a = spark.createDataFrame([("x", "r1", [1.0, 0.0]), ("y", "r2", [0.0, 1.0]), ("y", "r2", [0.0, 1.0])], schema)
    assert stores.stored(spark, path, schema).count() == 0
    assert stores.put(a, path, "id", "v", 2) == 2
    stores.put(spark.createDataFrame([("y", "r3", [1.0, 1.0])], schema), path, "id", "v", 2)
    assert {(r.id, r.revision_id) for r in stores.stored(spark, path, schema).collect()} == {("x", "r1"), ("y", "r3")}
    stores.remove(spark, path, schema, "revision_id", ["r1"])
    assert [r.id for r in stores.stored(spark, path, schema).collect()] == ["y"]
    for bad in ([1.0], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            stores.put(spark.createDataFrame([("z", "r", bad)], schema), path, "id", "v", 2)


def test_graphs_need_their_ends(spark, tmp_path):
    nodes = spark.createDataFrame([("d", "Document"), ("f", "Feature")], "key string, label string")
    edges = spark.createDataFrame([("1", "d", "f", "r1"), ("1", "d", "f", "r1")], "fact_id string, source string, target string, revision_id string")
    assert stores.put_graph(nodes, edges, str(tmp_path / "g")) == (2, 1)
    stores.remove_revision(spark, str(tmp_path / "g"), "fact_id string, source string, target string, revision_id string", "r1")
    assert stores.stored(spark, str(tmp_path / "g/edges"), "fact_id string, source string, target string, revision_id string").count() == 0
    assert stores.stored(spark, str(tmp_path / "g/nodes"), "key string, label string").count() == 2
    with pytest.raises(ValueError):
        stores.put_graph(nodes.where("key = 'd'"), edges, str(tmp_path / "h"))


def answer(key):
    if key == "bad":
        raise KeyError(key)
    return {"k": key}


def test_point_fetches_cache_and_lines(spark, tmp_path):
    got = {r.k: (r.value, r.problem) for r in stores.fetched(spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "k string"), "k", "tests.test_stores:answer").collect()}
    assert got == {"a": ('{"k": "a"}', None), "bad": (None, "KeyError")}
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [stores.cached(spark, str(tmp_path / "c"), make).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/a.jsonl").write_text(json.dumps({"n": 1}) + "\nbroken\n")
    q = stores.line_stream(spark, str(tmp_path / "lines"), "n int").writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n is None, r._line) for r in spark.sql("select * from lines").collect()) == [(False, '{"n": 1}'), (True, "broken")]


def test_injected_models(spark):
    df = spark.createDataFrame([(1, "gas sensor"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.v for r in df.select("id", models.embedder(models.hashed_terms(8), 8)("t").alias("v")).collect()}
    assert got[2] is None and got[3] == [0.0] * 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    bad = df.select(models.embedder(lambda: lambda texts: [[1.0]] * len(texts), 8)("t").alias("v"))
    with pytest.raises(Exception, match="wrong vector"):
        bad.collect()
    assert models.expanded_queries("Gas  sensor", [("film", 0.5), ("GAS SENSOR", 0.9), ("array", 0.7)], 1) == ["Gas sensor", "array"]
    assert {r.id: r.label for r in models.labelled(df, lambda: lambda rows: ["yes" if r[0] else "no" for r in rows], ["t"]).collect()} == {1: "yes", 2: "no", 3: "no"}
