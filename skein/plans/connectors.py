"""Sources and sinks: tables are written in a foreign form to the shared folder and read back through the connectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.io import table
from skein.plans.registry import Register
from skein.plans.relational import _CHUNKS, chunks
from skein.session import shared_folder
from skein.sources import files, patents, rest, stores, works
from skein.streaming import events as ev

register = Register()
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


def concept_pages(folder: str, cursor: str | None = None, size: int | None = None, start: int | None = None, stop: int | None = None) -> dict:
    """The reference names as a paged service would give them; the query is the folder of the tables."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{folder}/technical_concepts.parquet", columns=["concept_id", "canonical_name"]).sort_by("concept_id").to_pylist()
    if cursor is None:
        return {"results": rows[start:stop]}
    at = 0 if cursor == "*" else int(cursor)
    return {"results": rows[at : at + size], "next_cursor": str(at + size) if at + size < len(rows) else None}


def concept_answer(key: int) -> dict:
    """One record of a service by its key; every seventh is missing."""
    if key % 7 == 0:
        raise KeyError(key)
    return {"id": key, "square": key * key}


@register("SELECT p AS paging, concept_id, canonical_name FROM technical_concepts, (VALUES ('cursor'), ('window')) t(p)")
def paged_search(spark: SparkSession, folder: str) -> DataFrame:
    """A paged service read by cursor in one reader, and by offset windows as partitions."""
    rest.register(spark)
    out = None
    for paging in ("cursor", "window"):
        pages = spark.read.format("paged_rest").options(fetch="skein.plans.connectors:concept_pages", query=folder, pageSize=100, limit=2000, paging=paging).load()
        rows = pages.select(F.lit(paging).alias("paging"), F.from_json("value", "concept_id long, canonical_name string").alias("r")).select("paging", "r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("SELECT concept_id, CASE WHEN concept_id % 7 <> 0 THEN concept_id * concept_id END AS square, CASE WHEN concept_id % 7 = 0 THEN 'KeyError' END AS problem FROM technical_concepts")
def point_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Records fetched by key, with the failure named where one is missing."""
    got = stores.fetched(table(spark, folder, "technical_concepts"), "concept_id", "skein.plans.connectors:concept_answer")
    return got.select("concept_id", F.get_json_object("value", "$.square").cast("long").alias("square"), "problem")


@register(
    rf"""WITH d AS (SELECT *, {_WORDS} AS w FROM documents), a AS (SELECT *, CASE WHEN len(w) BETWEEN 1 AND 20000 THEN array_to_string(w, ' ') END AS abstract FROM d)
    SELECT 'W' || doc_id AS external_id, coalesce(nullif(trim(title), ''), 'W' || doc_id) AS title, strftime(publication_date, '%Y-%m-%d') AS publication_date, md5(abstract) AS abstract,
      CASE WHEN nullif(trim(title), '') IS NULL THEN 'missing' ELSE 'available' END AS title_status, CASE WHEN doc_id % 3 = 0 THEN 'available' ELSE 'missing' END AS doi_status FROM a WHERE coalesce(length(trim(abstract)), 0) >= 80"""
)
def works_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON works with inverted abstracts, read, typed, normalized and filtered by eligibility."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), "external_id")).otherwise(F.lit("https://other.example/10.1"))
    raw = table(spark, folder, "documents").select(
        F.concat(F.lit("https://openalex.org/W"), F.col("doc_id")).alias("id"), "title", tx.positions_of_words(words).alias("abstract_inverted_index"), F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), doi.alias("doi")
    )
    place = shared_folder(spark, "works")
    raw.select(F.to_json(F.struct("*")).alias("value")).write.text(place)
    normal = works.eligible(works.normalized_works(works.parse_works(works.read_works(spark, place, lines=True))))
    status = lambda f: F.get_json_object("metadata", f"$.field_status.{f}")
    return normal.select("external_id", "title", F.col("publication_date").cast("string").alias("publication_date"), F.md5(F.get("sections", F.lit(0))["text"]).alias("abstract"), status("title").alias("title_status"), status("doi").alias("doi_status"))


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


@register(
    rf"""SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'EP.' || doc_id || '.A1' END AS external_id, CASE WHEN doc_id % 11 = 0 THEN 'unsafe_xml' WHEN doc_id % 13 = 0 THEN 'invalid_xml' END AS problem,
      CASE WHEN doc_id % 11 <> 0 THEN strftime(publication_date, '%Y-%m-%d') END AS publication_date, CASE WHEN doc_id % 11 <> 0 THEN length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) END AS letters
    FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\p{{L}}\p{{N}}]') AND length(text) <= 100000 AND (doc_id % 11 = 0 OR doc_id % 13 <> 0)
    UNION ALL SELECT NULL, 'invalid_xml', NULL, NULL FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\p{{L}}\p{{N}}]') AND length(text) <= 100000 AND doc_id % 11 <> 0 AND doc_id % 13 = 0"""
)
def patents_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as patent XML with namespaces, parsed; every 11th declares an entity and every 13th is cut off. Texts beyond
    the size limit of the parser aren't written."""
    escaped = F.replace(F.replace(F.regexp_replace("text", _CONTROL, ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    number, day = F.col("doc_id").cast("string"), F.date_format("publication_date", "yyyyMMdd")
    head = F.when(F.col("doc_id") % 11 == 0, '<!DOCTYPE w [<!ENTITY e "x">]>').otherwise("")
    tail = F.when(F.col("doc_id") % 13 == 0, "").otherwise("</o:w>")
    xml = F.concat(
        head, F.lit('<o:w xmlns:o="urn:o" xmlns="urn:e"><exchange-document country="EP" kind="A1" doc-number="'), number, F.lit('"><publication-reference><document-id document-id-type="docdb"><date>'), F.coalesce(day, F.lit("")),
        F.lit("</date></document-id></publication-reference><description><p>"), escaped, F.lit("</p></description></exchange-document>"), tail,
    )
    d = table(spark, folder, "documents").where(F.col("text").rlike(r"[\p{L}\p{N}]") & (F.char_length("text") <= 100_000))
    got = patents.parsed_patents(d.select(number.alias("path"), F.encode(xml, "UTF-8").alias("content")))
    return got.select("external_id", "problem", F.col("publication_date").cast("string").alias("publication_date"), F.char_length(F.regexp_replace("description", r"[^\p{L}\p{N}]", "")).alias("letters"))


@register("SELECT doc_id, coalesce(title, '~') AS title, source FROM documents WHERE title IS NULL OR title <> ''")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_folder(spark, "csv")
    files.write_csv(table(spark, folder, "documents").where("title is null or title <> ''").select("doc_id", F.coalesce("title", F.lit("~")).alias("title"), "source"), place)
    return files.read_csv(spark, place, "doc_id long, title string, source string")


@register("SELECT DISTINCT revision_id, fact_count + 1 AS facts FROM graph_index_results")
def keyed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Two lines for each revision, with a broken line between; the last line of a key counts."""
    line = lambda n: F.to_json(F.struct("revision_id", (F.col("fact_count") + n).alias("facts")))
    place = shared_folder(spark, "lines")
    table(spark, folder, "graph_index_results").select(F.concat_ws("\n", line(0), F.lit("{broken"), line(1))).write.text(place)
    return files.read_keyed_lines(spark, place, "revision_id string, facts int", ["revision_id"])


@register("SELECT 200 + user_id % 4 AS status, count(*) AS n, round(sum(round(coalesce(value, 0), 1)), 1) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def log_window(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log lines, of which those of a window are parsed."""
    at = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat(at, F.lit(" GET /x status="), (200 + F.col("user_id") % 4).cast("string"), F.lit(" "), F.round(F.coalesce("value", F.lit(0.0)), 1).cast("decimal(18,1)").cast("string"), F.lit(" ms"))
    place = shared_folder(spark, "log")
    table(spark, folder, "events").select(line).write.text(place)
    log = files.read_log(spark, place, "2024-01-05", "2024-01-20")
    return log.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 1).alias("total"))


@register("SELECT label, count(*) AS vectors, count(*) FILTER (vec_id % 10 = 0) AS rewritten FROM embeddings WHERE label <> (SELECT min(label) FROM embeddings) GROUP BY label")
def vector_store(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors put by key, a tenth put again, one label removed, the rest counted."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", "embedding", F.lit(1).alias("version"))
    schema, first = ", ".join(f"{n} {t}" for n, t in e.dtypes), e.agg(F.min("label"), F.min(F.size("embedding"))).first()
    place = stores.store_path(shared_folder(spark, "vectors"), size=first[1])
    stores.put(e, place, "vec_id", "embedding", first[1])
    stores.put(e.where("vec_id % 10 = 0").withColumn("version", F.lit(2)), place, "vec_id", "embedding", first[1])
    stores.remove(spark, place, schema, "label", [first[0]])
    return stores.stored(spark, place, schema).groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(F.col("version") == 2).alias("rewritten"))


@register(
    f"""WITH {_CHUNKS}, r AS (SELECT min(revision_id) AS gone FROM chunks) SELECT 'edge' AS kind, section AS name, count(*) AS n FROM chunks, r WHERE revision_id <> gone AND document_id IS NOT NULL AND section IS NOT NULL GROUP BY section
    UNION ALL SELECT 'node', 'document', count(DISTINCT document_id) FROM chunks WHERE section IS NOT NULL UNION ALL SELECT 'node', 'section', count(DISTINCT section) FROM chunks WHERE document_id IS NOT NULL"""
)
def graph_store(spark: SparkSession, folder: str) -> DataFrame:
    """A graph of documents and sections is written, the edges of one revision are removed, nodes stay."""
    c = chunks(spark, folder).where("document_id is not null and section is not null").select("chunk_id", "document_id", "section", "revision_id")
    edges = c.select(F.col("chunk_id").alias("fact_id"), F.col("document_id").alias("source"), F.concat(F.lit("section:"), "section").alias("target"), "revision_id")
    nodes = edges.select(F.col("source").alias("key"), F.lit("document").alias("label")).union(edges.select("target", F.lit("section"))).distinct()
    place, schema = shared_folder(spark, "graph"), "fact_id string, source string, target string, revision_id string"
    stores.put_graph(nodes, edges, place)
    stores.remove_revision(spark, place, schema, chunks(spark, folder).agg(F.min("revision_id")).first()[0])
    left = stores.stored(spark, f"{place}/edges", schema).groupBy(F.substr("target", F.lit(9)).alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    kept = stores.stored(spark, f"{place}/nodes", "key string, label string").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return left.unionByName(kept)


@register("SELECT source, count(*) AS n FROM documents GROUP BY source")
def cached_result(spark: SparkSession, folder: str) -> DataFrame:
    """A result kept under its configuration; a later call gets the first result, whatever it would make."""
    place = stores.store_path(shared_folder(spark, "cache"), query="by source")
    stores.cached(spark, place, lambda: table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n")))
    return stores.cached(spark, place, lambda: spark.createDataFrame([("never", 1)], "source string, n long"))


@register("SELECT event_id, event_type, user_id FROM events")
def event_stream_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events encoded as server-sent events with comments between them, and decoded."""

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = ": beat\n\n".join(files.event_frame(int(i), kind, {"user": int(u), "note": "é\n"}) for i, kind, u in zip(batch["event_id"], batch["event_type"], batch["user_id"]))
            rows = [(e["id"], e["event"], e["data"]["user"]) for e in files.event_frames(text.splitlines(True))]
            yield pd.DataFrame(rows, columns=["event_id", "event_type", "user_id"])

    return table(spark, folder, "events").select("event_id", "event_type", "user_id").mapInPandas(through, "event_id long, event_type string, user_id long")


@register("SELECT DISTINCT cluster_id, coalesce(document_count, -1) AS documents, false AS broken FROM feature_clusters UNION ALL SELECT NULL, NULL, true FROM (SELECT 1)")
def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters as a stream of JSON lines, once each; a line that isn't JSON keeps its place."""
    place = shared_folder(spark, "stream")
    lines = table(spark, folder, "feature_clusters").select("cluster_id", F.coalesce("document_count", F.lit(-1)).alias("documents")).distinct()
    lines.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([("no json",)], "value string")).write.text(place)
    stream = stores.line_stream(spark, place, "cluster_id string, documents int")
    return ev.drained(stream, "lines").select("cluster_id", "documents", F.col("cluster_id").isNull().alias("broken"))


QUERIES, ORACLE = register.queries, register.sql
