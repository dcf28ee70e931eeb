import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import closure, components, graphs, latest, lexical, measures, packs, ranking, resolution, rules, snapshots, spans, vectors


def groups_of(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {"random": [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)], "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "star": [("n50", f"n{i:02}") for i in range(60)], "none": []}[shape]
    df = spark.createDataFrame([*pairs, *pairs[:3]] + [(None, "n1")], "u string, v string")
    got = {r.vertex: r.component for r in components.components(df, spark.createDataFrame([("alone",)], "vertex string")).collect()}
    want = {x: g for x, g in groups_of([p for p in pairs if p[0] != p[1]]).items()}
    assert got == want | {"alone": "alone"}


def test_ranks_over_tasks(spark):
    rows = [("a" if i % 3 else "b", (i * 7919) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(4)
    got = {r.i: r.rank for r in ranking.ranked(df, ["g"], [F.col("v").desc(), F.col("i")]).collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    assert sorted(r.rank for r in ranking.ranked(df, [], [F.col("i")]).collect()) == list(range(1, 501))


def test_fusion_counts_repeats_in_ranks_and_first_rows_only(spark):
    rows = [("l1", "k1", "c1", "s", 0.9, ["x"]), ("l1", "k1", "c2", "s", 0.8, ["x"]), ("l1", "k2", "c3", "s", 0.7, ["x"]), ("l2", "k2", "c4", "a", 0.5, ["y"])]
    df = spark.createDataFrame(rows, "l string, k string, c string, section string, score double, channels array<string>")
    got = {r.k: r for r in ranking.reciprocal_rank_fusion(df, "l", "k", "c", "section", [F.col("score").desc(), F.col("c")], "channels").collect()}
    assert math.isclose(got["k1"].score, 1 / 61) and math.isclose(got["k2"].score, 1 / 63 + 1 / 61)
    assert got["k2"].c == "c4" and got["k2"].channels == ["x", "y"]


def test_bm25_against_a_plain_computation(spark):
    texts = ["zno sensor sensor", "zno film", "", "other words here now"]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "id int, text string, length double")
    got = {r.id: r.score for r in lexical.bm25(df, tx.terms("text"), "sensor zno sensor").collect()}
    docs = [tx.term_list(t) for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    for i, d in enumerate(docs):
        want = 0.0
        for q in ["sensor", "zno", "sensor"]:
            f, n = d.count(q), sum(q in x for x in docs)
            want += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / avg)) if f else 0
        assert math.isclose(got[i], want, rel_tol=1e-12)
    assert lexical.bm25(df.limit(0), tx.terms("text"), "x").count() == 0


def test_nearest_is_exact_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 6))
    m[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "id long, v array<double>")
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    got = vectors.nearest(df, df.where("id % 4 = 0"), "id", "v", 5).collect()
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    for q in range(0, 90, 4):
        s = np.round(u @ u[q], 9)
        want = sorted((-s[i], i) for i in range(90) if i != q)[:5]
        assert [r.neighbour_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in want]
    bins = {r.bin: r.pairs for r in vectors.similarity_histogram(df, df.where("id % 4 = 0"), "id", "v", 4).collect()}
    assert sum(bins.values()) == 23 * 89


def test_pooling_and_medoid(spark):
    df = spark.createDataFrame([("g", 1, [2.0, 0.0]), ("g", 2, [0.0, 3.0]), ("g", 3, [1.0, 1.0]), ("z", 4, [0.0, 0.0])], "g string, id int, v array<double>")
    got = {(r.g, r.position): r.value for r in vectors.pooled(df, "g", "v").collect()}
    assert math.isclose(got["g", 0], math.sqrt(0.5)) and got["z", 0] == 0.0
    assert {r.g: r.id for r in vectors.medoids(df, "g", "id", "v").collect()} == {"g": 3, "z": 4}


def decisions(spark, rows):
    return spark.createDataFrame(rows, "feature_a string, feature_b string, decision string, same_probability double, confidence double")


def test_cannot_links_block_in_order_of_confidence(spark):
    d = decisions(spark, [("a", "b", "SAME", 0.99, 0.99), ("c", "b", " same", 0.98, 0.99), ("a", "c", "DIFFERENT", 0.1, 0.1), ("e", "e", "SAME", 1.0, 1.0), ("f", None, "SAME", 1.0, 1.0), ("g", "h", "UNCERTAIN", 1.0, 1.0)])
    got = resolution.constrained_clusters(d, 0.9).collect()
    assert {r.feature: r.cluster for r in got if r.kind == "member"} == {"a": "a", "b": "a", "c": "c"}
    assert [(r.feature, r.cluster, r.cannot_a, r.cannot_b) for r in got if r.kind == "conflict"] == [("b", "c", "a", "c")]
    assert resolution.constrained_clusters(d.limit(0), 0.9).count() == 0


def test_rounds_equal_the_order(spark):
    rng = random.Random(4)
    names = [f"f{i:02}" for i in range(9)]
    rows = [(*rng.sample(names, 2), rng.choice(["SAME", "SAME", "DIFFERENT"]), rng.choice([0.9, 0.95, 0.99]), rng.random() * 0.1 + 0.9) for _ in range(14)]
    d = decisions(spark, rows)
    pairs = [tuple(r) for r in resolution.accepted_pairs(d, 0.9).collect()]
    apart = {tuple(r) for r in resolution.cannot_links(d).collect()}
    owner, blocked = resolution.merge_in_order(pairs, apart)
    got = resolution.merged_by_rounds(resolution.accepted_pairs(d, 0.9), resolution.cannot_links(d)).collect()
    assert {r.feature: r.cluster for r in got if r.kind == "member"} == owner
    assert {(r.feature, r.cluster) for r in got if r.kind == "conflict"} == {b[:2] for b in blocked}
    whole = resolution.constrained_clusters(d, 0.9).collect()
    assert {r.feature: r.cluster for r in whole if r.kind == "member"} == owner


def test_pair_counts_without_pairs(spark):
    rng = random.Random(5)
    edges = [(f"d{rng.randrange(40)}", f"f{rng.randrange(25)}") for _ in range(90)] + [(f"d{i}", "hot") for i in range(15)]
    docs = defaultdict(set)
    for d, f in edges:
        docs[f].add(d)
    want = len({(a, b) for s in docs.values() for a in s for b in s if a < b})
    df = spark.createDataFrame(edges, "d string, f string")
    assert graphs.connected_document_pairs(df, "d", "f").first().pairs == want
    assert graphs.connected_document_pairs(df.limit(0), "d", "f").first().pairs == 0


def test_levels_cycles_and_closure(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "p string, q string")
    placed, left = closure.levels(df, "p", "q")
    assert {r.node: r.level for r in placed.collect()} == {"a": 0, "b": 1, "c": 2} and {r.node for r in left.collect()} == {"x", "y", "z"}
    got = {(r.p, r.q): r.distance for r in closure.closure(df, "p", "q").collect()}
    assert got["a", "c"] == 1 and got["x", "x"] == 2 and got["x", "z"] == 2 and ("c", "a") not in got


def test_newest_snapshot_and_reconciliation(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 5, None)], "k string, t int, v string")
    assert {(r.k, r.v) for r in latest.newest(df, ["k"], F.col("t")).collect()} == {("k", "new"), ("j", None)}
    a = spark.createDataFrame([("x", 1), ("y", 2), ("n", None)], "k string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4), ("n", None)], "k string, v int")
    assert {r.k: r.state for r in snapshots.reconcile(a, b, "k", "v").collect()} == {"x": "left_only", "y": "differs", "z": "right_only", "n": "equal"}
    assert {tuple(r) for r in snapshots.upsert(a, b, "k").collect()} == {("x", 1), ("y", 3), ("z", 4), ("n", None)}
    assert {(r.k, r.side) for r in snapshots.symmetric_difference(a, b).collect()} == {("x", "left"), ("y", "left"), ("y", "right"), ("z", "right")}


def test_gaps_and_occurrences(spark):
    t = spark.createDataFrame([("a", "ab  cd😀e"), ("b", "  ")], "k string, t string")
    s = spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("a", 4, 5), ("a", 3, 3)], "k string, s int, e int")
    assert [tuple(r) for r in spans.uncovered(t, "k", "t", s, "s", "e").collect()] == [("a", 5, 8)]
    o = spark.createDataFrame([("aaa", "aa"), ("x", None), ("x", "")], "t string, q string")
    assert [r[0] for r in o.select(spans.occurrences("t", "q")).collect()] == [2, None, 0]


def test_quantiles_by_place(spark):
    for n in (1, 2, 19, 20, 21, 100):
        v = [float((i * 37) % n) for i in range(n)]
        r = spark.createDataFrame([(x,) for x in v], "v double").agg(measures.truncated_quantile(F.col("v"), 0.95).alias("t"), measures.floor_quantile(F.col("v"), 0.95).alias("f")).first()
        s = sorted(v)
        assert r.t == s[int((n - 1) * 0.95)] and r.f == s[max(0, int(n * 0.95) - 1)]


def test_packs_skip_what_does_not_fit():
    entries = [("d1", "c1", [(0, 5, "x" * 60), (6, 9, "ok")]), ("d1", "c2", [(0, 1, "again")]), ("d2", "c3", [(0, 9, "y" * 500)]), ("d3", "c4", [(0, 2, "z")])]
    item = lambda d, c, a, b, q: {"document_id": d, "chunk_id": c, "span_start": a, "span_end": b, "quote": q}
    size = lambda items: len(json.dumps(items, separators=(",", ":")))
    both = [item("d1", "c1", 6, 9, "ok"), item("d3", "c4", 0, 2, "z")]
    got = packs.fill_pack(entries, len, size(both), 2)
    assert got == [item("d1", "c1", 0, 5, "x" * 60)] or got == both
    tight = packs.fill_pack(entries, len, size([both[0]]) + 5, 2)
    assert tight == [both[0]]  # the long excerpt is skipped, the short one behind it fits
    with pytest.raises(ValueError):
        packs.fill_pack(entries, len, 3, 2, prefix="long frame")


def test_rules(spark):
    df = spark.createDataFrame([({"A": 0.6, "B": 0.4}, "A"), ({"A": 0.6, "B": 0.4}, "B"), ({"A": 1.0}, "A"), ({"A": float("nan"), "B": 0.4}, "A"), (None, "A")], "p map<string, double>, l string")
    assert [r[0] for r in df.select(rules.probabilities_valid(F.col("p"), ["A", "B"], F.col("l"))).collect()] == [True, False, False, False, False]
    pairs = {
        ("n-type film", "p-type film"): "CARRIER_POLARITY", ("n-type SnO2", "p-type CuO"): "CARRIER_POLARITY", ("P type film", "N -type film"): "CARRIER_POLARITY", ("oxidation of CO", "reduction of NO2"): "OXIDATION_REDUCTION", ("oxidized film", "Reduction"): "OXIDATION_REDUCTION",
        ("film with Pd", "film without Pd"): "QUALIFIER", ("increased response", "decreased response"): "QUALIFIER", ("high drift", "low drift"): "QUALIFIER", ("Positive, shift", "negative shift"): "QUALIFIER", ("response to NO2", "response to NH3"): "ANALYTE", ("no 2", "NH 3"): "ANALYTE",
        ("high drift", "high drift"): None, ("high drift", "low noise"): None, ("high", "low"): None, ("film with Pd", "layer without Pd"): None, ("NO2 film", "CO film"): None, ("n-types", "p-type"): None, ("x", None): None,
    }
    v = spark.createDataFrame(list(pairs), "a string, b string")
    assert [r[0] for r in v.select(rules.veto_reason(F.col("a"), F.col("b"))).collect()] == list(pairs.values())
    m = spark.createDataFrame([('{"Token": "abc", "x": 1, "h": "Bearer a.b-c"}',)], "t string").select(rules.masked(F.col("t"))).first()[0]
    assert m == '{"Token": "[masked]", "x": 1, "h": "Bearer [masked]"}'
    r = spark.createDataFrame([("abcabx", "ab", 0, 2), ("abcabx", "cab", 9, 12), ("abcabx", "ab", 1, 3), ("abc", "z", 0, 1), (None, "a", 0, 1), ("abc", "", 0, 0)], "t string, s string, a int, b int")
    assert [x.r.code for x in r.select(rules.reanchored("t", "s", "a", "b").alias("r")).collect()] == ["REPORTED", "RECOVERED", "AMBIGUOUS", "NOT_FOUND", "TEXT_MISSING", "SURFACE_EMPTY"]


def test_text_functions(spark):
    assert tx.feature_form("Gas‐Sensor, (n-type) 2.5 V/+5 -") == "gas sensor n type 2.5 v +5 -"
    assert tx.feature_form("ＺｎＯ  Ｆｉｌｍ!") == "zno film"
    df = spark.createDataFrame([("HTTP://A.B/x//?q=1#f",), ("a/b",), (None,)], "u string")
    assert [r[0] for r in df.select(tx.canonical_url(F.col("u"))).collect()] == ["http://a.b/x?q=1", "a/b", None]
    k = spark.createDataFrame([("é" * 300,), ("",), ("a?b>",)], "t string").select("t", tx.url_key(F.col("t")).alias("k"))
    assert all(r.t == r.b for r in k.select("t", tx.from_url_key(F.col("k")).alias("b")).collect())
    assert tx.canonical_json('{"b": 1, "a": [2]}') == '{"a":[2],"b":1}' and tx.canonical_json("x") is None


@pytest.mark.parametrize("limit", [10, 40])
def test_chunks_are_exact_and_bounded(limit):
    rng = random.Random(limit)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "longerword ", "x. ", "Y! ", "\n", "  ", "無。", "😀"]) for _ in range(rng.randint(0, 30)))
        found = tx.chunk_spans(text, "zh", limit)
        assert all(0 < b - a <= limit and not text[a].isspace() for a, b in found)
        covered = "".join(text[a:b] for a, b in found)
        assert "".join(covered.split()) == "".join(text.split()) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert tx.chunk_spans("", "en", limit) == [] == tx.chunk_spans(" \n ", "en", limit)
    # sentences are kept together as long as they fit, a long one is cut at a blank, a long word at the limit
    assert tx.chunk_spans("One. Two. Three four.", "en", 10) == [(0, 9), (10, 15), (16, 21)]
    assert tx.chunk_spans("A. " + "x" * 25 + " end.", "en", 10) == [(0, 2), (3, 13), (13, 23), (23, 33)]


def test_a_checkpoint_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from skein import session

    unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: unset), getConf=lambda: SimpleNamespace(get=lambda k: None), master="spark://host:7077")
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))
    with pytest.raises(RuntimeError):
        session.cut(df)


def test_keyed_hash_equals_the_standard(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("",), ("é|x",), ("m" * 500,), (None,)], "t string")
    for key in (b"k", b"long" * 40):
        got = [r[0] for r in df.select(tx.hmac_sha256(F.col("t"), key)).collect()]
        assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in ("", "é|x", "m" * 500)] + [None]


def test_patches_in_order(spark):
    from skein.operators import snapshots

    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3"), ("b", None), ("c", None), ("c", "4")],), ([],), (None,)], "p array<struct<k: string, v: string>>")
    assert [r[0] for r in df.select(snapshots.replayed("p", "k", "v")).collect()] == [{"a": "3", "b": None, "c": "4"}, {}, None]


def test_answers_make_a_relation_or_a_contradiction(spark):
    import itertools

    def plain(c, a, s, r):
        if None in (c, a, s, r):
            return "INVALID"
        if c and (a or s):
            return "CONTRADICTION_AND_SUPPORT"
        if a and not s:
            return "ALL_WITHOUT_SOME"
        if s and not r:
            return "SOME_WITHOUT_RELEVANCE"
        return "conflicting" if c else "full" if a else "partial" if s else "uncertain" if r else "none"

    rows = list(itertools.product([True, False, None], repeat=4))
    df = spark.createDataFrame(rows, "c boolean, a boolean, s boolean, r boolean")
    got = df.select("*", rules.relation_of({k: F.col(k) for k in "casr"}).alias("x")).collect()
    assert all(g.x == plain(g.c, g.a, g.s, g.r) for g in got) and len(got) == 81
