import json

from pyspark.sql import functions as F

from skein.sources import files, patents, rest, works


def test_works_are_typed_and_their_gaps_named(spark, tmp_path):
    work = {
        "id": "https://openalex.org/W12", "display_name": " Sensor ", "abstract_inverted_index": {"gas": [1], "A": [0], "sensor": [2]},
        "publication_date": "2024-02-30", "doi": "https://example.org/10.1/x", "authorships": [{"author": {"id": "https://openalex.org/A3", "display_name": "X"}}, {"author": None}],
        "topics": [{"id": "T9", "display_name": "", "score": 0.5}], "referenced_works": ["W1", "nonsense"], "cited_by_count": -1,
    }
    (tmp_path / "a.json").write_text(json.dumps(work))
    (tmp_path / "b.json").write_text(json.dumps({"id": "none", "title": "dropped"}))
    row = works.parse_works(works.read_works(spark, str(tmp_path))).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.external_id, r.title, r.abstract, r.publication_date, r.doi, r.cited_by_count) == ("W12", "Sensor", "A gas sensor", None, None, None)
    assert r.referenced_work_ids == ["W1"] and r.authors[0].id == "A3" and len(r.authors) == 1 and r.topics[0].name is None
    assert r.field_status["abstract"] == "available" and r.field_status["doi"] == "missing"
    n = works.normalized_works(works.parse_works(works.read_works(spark, str(tmp_path)))).first()
    assert n.canonical_url.endswith("/W12") and n.sections[0].text == "A gas sensor"


def test_an_index_with_gaps_or_repeats_has_no_text(spark):
    from skein.functions.text import words_by_position

    df = spark.createDataFrame([({"a": [0], "b": [2]},), ({"a": [0], "b": [0]},), ({"a": [0, 1]},), ({},), (None,)], "m map<string, array<int>>")
    assert [r[0] for r in df.select(words_by_position(F.col("m"))).collect()] == [None, None, "a a", None, None]


XML = """<?xml version="1.0"?><o:w xmlns:o="urn:o" xmlns="urn:e"><exchange-document country="EP" doc-number="1000000" kind="A1">
<publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>1000000</doc-number><kind>A1</kind><date>20000517</date></document-id></publication-reference>
<invention-title lang="de">Messer</invention-title><invention-title lang="en">Meter</invention-title><abstract lang="fr"><p>Un  mètre.</p></abstract>
<claims><claim>1. A</claim><claim>2. B</claim></claims></exchange-document>
<exchange-document country="WO" doc-number="1"><invention-title>no kind</invention-title></exchange-document></o:w>"""


def test_patents_prefer_english_and_refuse_unsafe_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text('<!DOCTYPE x [<!ENTITY e "x">]><x>&e;</x>')
    (tmp_path / "c.xml").write_text("<open>")
    rows = {r.problem or r.external_id: r for r in patents.read_patents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"EP.1000000.A1", "unsafe_xml", "invalid_xml"}
    r = rows["EP.1000000.A1"]
    assert (r.title, r.abstract, str(r.publication_date), r.claims, r.description) == ("Meter", "Un mètre.", "2000-05-17", "1. A\n2. B", None)
    n = patents.normalized_patents(patents.read_patents(spark, str(tmp_path))).collect()
    assert len(n) == 1 and [s.name for s in n[0].sections] == ["abstract", "claims"]


def pages(query, cursor=None, size=None, start=None, stop=None):
    rows = [{"n": i, "q": query} for i in range(23)]
    if cursor is None:
        return {"results": rows[start:stop]}
    at = 0 if cursor == "*" else int(cursor)
    return {"results": rows[at : at + size], "next_cursor": str(at + size) if at + size < 23 else None}


def test_paged_source_reads_cursors_and_windows(spark):
    rest.register(spark)
    for paging in ("cursor", "window"):
        got = spark.read.format("paged_rest").options(fetch="tests.test_sources:pages", query="x", pageSize=10, limit=100, paging=paging).load()
        assert sorted(json.loads(r.value)["n"] for r in got.collect()) == list(range(23))


def test_patience_waits_as_asked_and_gives_up():
    waits, answers = [], [rest.Refused(7), rest.Refused(), {"ok": 1}]

    def call():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert rest.with_patience(call, sleep=waits.append) == {"ok": 1} and waits == [7, 1.0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\ufeffa,b\n1,\"x, \"\"y\"\"\"\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string").collect()] == [(1, 'x, "y"')]
    (tmp_path / "k.jsonl").write_text('{"k": 1, "v": "old"}\n{"k": 2, "v": "b"}\nbroken\n{"k": 1, "v": "new"}\n')
    assert {tuple(r) for r in files.read_keyed_lines(spark, str(tmp_path / "k.jsonl"), "k int, v string", ["k"]).collect()} == {(1, "new"), (2, "b")}
    (tmp_path / "s.log").write_text("2024-01-01T00:00:05 GET status=200 12.5 ms\n2024-01-02 00:00:00 status=500\nnoise\n")
    log = files.read_log(spark, str(tmp_path / "s.log"), "2024-01-01", "2024-01-02").collect()
    assert [(r.status, r.duration_ms) for r in log] == [(200, 12.5)]
    files.write_snapshot([{"b": 1, "a": "ü"}], str(tmp_path / "snap"))
    assert files.load_snapshot(str(tmp_path / "snap")) == [{"a": "ü", "b": 1}]
    (tmp_path / "snap").write_text("[]")
    try:
        files.load_snapshot(str(tmp_path / "snap"))
        raise AssertionError
    except ValueError:
        pass
    parents = spark.createDataFrame([(1, "p"), (2, "q")], "id int, t string")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, n int, x string")
    files.export_lines(parents, children, "id", ["n"], str(tmp_path / "out"))
    got = {json.loads(r.value)["id"]: json.loads(r.value).get("children") for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert [c["x"] for c in got[1]] == ["a", "b"] and got[2] is None
    assert "More than 1 rows." in files.report_markdown(parents, "T", 1)


def test_event_frames_decode_what_was_encoded():
    text = ": hello\n\n" + files.event_frame(1, "text", {"t": "é\n"}) + files.event_frame(2, "end", {})
    assert [(e["id"], e["event"], e["data"]) for e in files.event_frames(text.splitlines(True))] == [(1, "text", {"t": "é\n"}), (2, "end", {})]


def test_inverted_index_keeps_long_and_empty_texts(spark, tmp_path):
    from skein.plans import texts

    rows = [(1, "a b  a"), (2, "w " * 20_001), (3, " \n"), (4, ""), (5, "v " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.words, r.same) for r in texts.inverted_index_text(spark, str(tmp_path)).collect()}
    assert got == {1: (3, True), 2: (20_001, None), 3: (0, None), 4: (0, None), 5: (20_000, True)}


def test_relational_tables_round_trip(spark, tmp_path):
    from skein.sources import relational

    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(0, 500).select("id", (F.col("id") % 7).cast("int").alias("n"), F.concat(F.lit("é"), "id").alias("t"))
    relational.write_table(df, url, "items", partitions=2, **options)
    got = relational.read_table(spark, url, "items", "id", 4, **options)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    few = got.where("n = 3").select("t")
    assert "EqualTo(n,3)" in few._jdf.queryExecution().executedPlan().toString().replace(" ", "") and few.count() == 71
    relational.write_table(df.limit(0), url, "empty", **options)
    assert relational.read_table(spark, url, "empty", "id", **options).count() == 0
