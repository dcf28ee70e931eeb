"""Joins, set operations, windows and pages over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.io import table
from skein.operators import ranking, snapshots, spans
from skein.operators.latest import newest
from skein.plans.registry import Register

register = Register()

_CHUNKS = "chunks AS (SELECT DISTINCT ON (chunk_id) * FROM graph_chunks ORDER BY chunk_id, received_at DESC)"
_MENTIONS = "mentions AS (SELECT DISTINCT ON (mention_id) * FROM concept_mentions ORDER BY mention_id, received_at DESC)"
_EVIDENCE = "evidence AS (SELECT DISTINCT ON (evidence_id) * FROM candidate_evidence ORDER BY evidence_id, received_at DESC)"
_CANDIDATES = "candidates AS (SELECT DISTINCT ON (candidate_id) * FROM graph_candidates ORDER BY candidate_id, received_at DESC)"
_ASSERTIONS = "assertions AS (SELECT DISTINCT ON (assertion_id) * FROM annotations ORDER BY assertion_id, received_at DESC)"


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return newest(table(spark, folder, "graph_chunks"), ["chunk_id"], F.col("received_at"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    return newest(table(spark, folder, "concept_mentions"), ["mention_id"], F.col("received_at"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    return newest(table(spark, folder, "candidate_evidence"), ["evidence_id"], F.col("received_at"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return newest(table(spark, folder, "graph_candidates"), ["candidate_id"], F.col("received_at"))


def assertions(spark: SparkSession, folder: str) -> DataFrame:
    return newest(table(spark, folder, "annotations"), ["assertion_id"], F.col("received_at"))


@register("SELECT chunk_id, epoch_us(max(received_at)) AS received_us, count(*) AS deliveries FROM graph_chunks GROUP BY chunk_id")
def newest_delivery(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_chunks").groupBy("chunk_id").agg(F.unix_micros(F.max("received_at").cast("timestamp")).alias("received_us"), F.count("*").alias("deliveries"))


@register(f"WITH {_MENTIONS} SELECT mention_id, concept_type, round(confidence, 6) AS confidence, epoch_us(received_at) AS received_us FROM mentions")
def newest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return mentions(spark, folder).select("mention_id", "concept_type", F.round("confidence", 6).alias("confidence"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"))


@register(
    f"""WITH {_CHUNKS}, {_EVIDENCE} SELECT e.source, c.section, count(*) AS rows, count(DISTINCT c.document_id) AS documents
    FROM evidence e JOIN chunks c USING (chunk_id) JOIN graph_index_results r ON c.revision_id = r.revision_id JOIN documents d ON d.document_id = c.document_id GROUP BY ALL"""
)
def evidence_in_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence joined with its chunk, the chunk's indexed revision and its document."""
    c = chunks(spark, folder).select("chunk_id", "revision_id", "document_id", "section")
    r = table(spark, folder, "graph_index_results").select("revision_id")
    d = table(spark, folder, "documents").select("document_id")
    e = evidence(spark, folder).select("chunk_id", "source")
    joined = e.join(c, "chunk_id").join(r, "revision_id").join(d, "document_id")
    return joined.groupBy("source", "section").agg(F.count("*").alias("rows"), F.count_distinct("document_id").alias("documents"))


@register(
    f"""WITH {_CHUNKS}, {_CANDIDATES} SELECT g.candidate_id, c.document_id, c.revision_id, r.indexer_version FROM candidates g JOIN chunks c ON g.evidence_chunk_id = c.chunk_id
    JOIN graph_index_results r USING (revision_id) JOIN documents d ON d.document_id = c.document_id WHERE g.edge_type IN ('DISCLOSES_FEATURE', 'USES_TECHNOLOGY')"""
)
def fact_provenance(spark: SparkSession, folder: str) -> DataFrame:
    g = candidates(spark, folder).where(F.col("edge_type").isin("DISCLOSES_FEATURE", "USES_TECHNOLOGY")).select("candidate_id", F.col("evidence_chunk_id").alias("chunk_id"))
    c = chunks(spark, folder).select("chunk_id", "document_id", "revision_id")
    r = table(spark, folder, "graph_index_results").select("revision_id", "indexer_version")
    return g.join(c, "chunk_id").join(r, "revision_id").join(table(spark, folder, "documents").select("document_id"), "document_id").select("candidate_id", "document_id", "revision_id", "indexer_version")


@register("SELECT document_id, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM graph_index_results r WHERE r.document_id = d.document_id)")
def unindexed_documents(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "graph_index_results").select("document_id")
    return table(spark, folder, "documents").select("document_id", "doc_id").join(done, "document_id", "left_anti")


@register("SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'error' AND a.ts >= e.ts)")
def anti_unacked(spark: SparkSession, folder: str) -> DataFrame:
    """Outbox shape: purchases that no later error of the same user acknowledges. The acknowledgements are reduced to one row per user."""
    e = table(spark, folder, "events")
    acked = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.where("event_type = 'purchase'").join(acked, "user_id", "left").where("last is null or last < ts").select("event_id", "user_id")


@register(f"WITH {_MENTIONS}, {_CHUNKS} SELECT mention_id FROM mentions m WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = m.chunk_id AND c.deleted_at IS NULL AND c.language = 'en')")
def semi_members(spark: SparkSession, folder: str) -> DataFrame:
    live = chunks(spark, folder).where("deleted_at is null and language = 'en'").select("chunk_id")
    return mentions(spark, folder).select("mention_id", "chunk_id").join(live, "chunk_id", "left_semi").select("mention_id")


@register(
    f"""WITH {_MENTIONS}, {_CANDIDATES} SELECT m.mention_id, g.candidate_id, g.edge_type FROM mentions m JOIN candidates g ON m.chunk_id = g.evidence_chunk_id
    WHERE m.start_offset < g.span_end AND m.end_offset > g.span_start"""
)
def span_overlap(spark: SparkSession, folder: str) -> DataFrame:
    m = mentions(spark, folder).select("mention_id", "chunk_id", "start_offset", "end_offset")
    g = candidates(spark, folder).select("candidate_id", "edge_type", F.col("evidence_chunk_id").alias("chunk_id"), "span_start", "span_end")
    return spans.overlapping(m, g, "chunk_id", ("start_offset", "end_offset"), ("span_start", "span_end")).select("mention_id", "candidate_id", "edge_type")


@register(
    f"""WITH {_MENTIONS}, {_CANDIDATES} SELECT mention_id FROM mentions m WHERE EXISTS (SELECT 1 FROM candidates g WHERE m.chunk_id = g.evidence_chunk_id AND g.span_start <= m.start_offset AND m.end_offset <= g.span_end)"""
)
def span_containment(spark: SparkSession, folder: str) -> DataFrame:
    m = mentions(spark, folder).select("mention_id", "chunk_id", "start_offset", "end_offset")
    g = candidates(spark, folder).select(F.col("evidence_chunk_id").alias("chunk_id"), "span_start", "span_end")
    return spans.contained(m, g, "chunk_id", ("start_offset", "end_offset"), ("span_start", "span_end")).select("mention_id")


@register(f"WITH {_CANDIDATES}, {_CHUNKS} SELECT g.candidate_id, c.chunk_id, c.section FROM candidates g JOIN chunks o ON g.evidence_chunk_id = o.chunk_id JOIN chunks c ON c.revision_id = o.revision_id WHERE contains(c.text, g.quote)")
def substring_theta(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of a quote's revision that contains the quote: the revision is the join key, containment the residual."""
    c = chunks(spark, folder).select("chunk_id", "revision_id", "section", "text")
    g = candidates(spark, folder).select("candidate_id", "quote", F.col("evidence_chunk_id").alias("chunk_id")).join(c.select("chunk_id", "revision_id"), "chunk_id").drop("chunk_id")
    return g.join(c, "revision_id").where("contains(text, quote)").select("candidate_id", "chunk_id", "section")


@register(
    f"""WITH {_CANDIDATES}, {_CHUNKS}, n AS (SELECT g.candidate_id, sum((SELECT count(*) FROM range(1, length(c.text) + 1) r(i) WHERE substr(c.text, i, length(g.quote)) = g.quote)) AS n
      FROM candidates g JOIN chunks o ON g.evidence_chunk_id = o.chunk_id JOIN chunks c ON c.revision_id = o.revision_id WHERE contains(c.text, g.quote) AND g.quote <> '' GROUP BY g.candidate_id)
    SELECT candidate_id FROM n WHERE n = 1"""
)
def unique_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes that occur exactly once in their revision, overlapping occurrences counted."""
    c = chunks(spark, folder).select("chunk_id", "revision_id", "text")
    g = candidates(spark, folder).where("quote <> ''").select("candidate_id", "quote", F.col("evidence_chunk_id").alias("chunk_id")).join(c.select("chunk_id", "revision_id"), "chunk_id").drop("chunk_id")
    found = g.join(c, "revision_id").where("contains(text, quote)").withColumn("n", spans.occurrences("text", "quote"))
    return found.groupBy("candidate_id").agg(F.sum("n").alias("n")).where("n = 1").select("candidate_id")


@register(
    f"""WITH {_CHUNKS}, l AS (SELECT document_id AS k, count(*) AS v FROM chunks GROUP BY 1), r AS (SELECT document_id AS k, fact_count::BIGINT AS v FROM graph_index_results)
    SELECT coalesce(l.k, r.k) AS document_id, l.v AS left_value, r.v AS right_value, CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' WHEN l.v IS NOT DISTINCT FROM r.v THEN 'equal' ELSE 'differs' END AS state
    FROM l FULL JOIN r ON l.k = r.k"""
)
def reconcile_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and facts of each document in two stores."""
    left = chunks(spark, folder).groupBy("document_id").agg(F.count("*").alias("n"))
    right = table(spark, folder, "graph_index_results").select("document_id", F.col("fact_count").cast("long").alias("n"))
    return snapshots.reconcile(left, right, "document_id", "n")


@register(f"WITH {_ASSERTIONS} SELECT assertion_id, head_mention_id FROM assertions WHERE lower(trim(head_mention_id)) = lower(trim(tail_mention_id))")
def self_references(spark: SparkSession, folder: str) -> DataFrame:
    same = F.lower(F.trim("head_mention_id")) == F.lower(F.trim("tail_mention_id"))
    return assertions(spark, folder).where(same).select("assertion_id", "head_mention_id")


@register(f"WITH {_MENTIONS} SELECT t.concept_type, t.canonical_name, count(m.mention_id) AS mentions, count(DISTINCT m.chunk_id) AS chunks FROM technical_concepts t LEFT JOIN mentions m ON m.canonical_name = t.canonical_name GROUP BY ALL")
def optional_match(spark: SparkSession, folder: str) -> DataFrame:
    counts = mentions(spark, folder).groupBy("canonical_name").agg(F.count("*").alias("mentions"), F.count_distinct("chunk_id").alias("chunks"))
    names = table(spark, folder, "technical_concepts").select("concept_type", "canonical_name")
    return names.join(counts, "canonical_name", "left").fillna(0, ["mentions", "chunks"]).select("concept_type", "canonical_name", "mentions", "chunks")


@register(
    """WITH a AS (SELECT document_id, extraction_seconds FROM graph_index_results WHERE indexer_version = 'graph-index-v1'), b AS (SELECT document_id, extraction_seconds FROM graph_index_results WHERE indexer_version = 'graph-index-v2')
    SELECT d.source, count(a.document_id) AS v1, count(b.document_id) AS v2, round(avg(b.extraction_seconds) - avg(a.extraction_seconds), 6) AS difference FROM documents d LEFT JOIN a USING (document_id) LEFT JOIN b USING (document_id) GROUP BY d.source"""
)
def version_comparison(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "graph_index_results")
    v = lambda n: r.where(F.col("indexer_version") == f"graph-index-v{n}").select("document_id", F.col("extraction_seconds").alias(f"s{n}"), F.lit(1).alias(f"v{n}"))
    d = table(spark, folder, "documents").select("document_id", "source").join(v(1), "document_id", "left").join(v(2), "document_id", "left")
    return d.groupBy("source").agg(F.count("v1").alias("v1"), F.count("v2").alias("v2"), F.round(F.avg("s2") - F.avg("s1"), 6).alias("difference"))


@register("WITH c AS (SELECT o_orderkey, o_custkey FROM orders) SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    c = table(spark, folder, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")
    return c.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, revision_id, section, row_number() OVER (PARTITION BY revision_id, section ORDER BY ordinal, chunk_id) - 1 AS place FROM chunks")
def ordinal_in_section(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("revision_id", "section").orderBy("ordinal", "chunk_id")
    return chunks(spark, folder).select("chunk_id", "revision_id", "section", (F.row_number().over(w) - 1).cast("long").alias("place"))


@register("SELECT document_id, 'D' || lpad((row_number() OVER (ORDER BY document_id))::VARCHAR, 9, '0') AS code FROM documents")
def document_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes by place in the order of ids, numbered over all tasks without a single sorted partition."""
    placed = ranking.ranked(table(spark, folder, "documents").select("document_id"), [], [F.col("document_id")], "n")
    return placed.select("document_id", F.concat(F.lit("D"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("code"))


@register(f"WITH {_EVIDENCE} SELECT chunk_id, section, evidence_id FROM evidence WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY section, evidence_id) = 1")
def representative_record(spark: SparkSession, folder: str) -> DataFrame:
    e = evidence(spark, folder).where("chunk_id is not null")
    return e.groupBy("chunk_id").agg(F.min(F.struct("section", "evidence_id")).alias("m")).select("chunk_id", "m.section", "m.evidence_id")


@register(
    """WITH p AS (SELECT least(feature_a, feature_b) AS a, greatest(feature_a, feature_b) AS b, upper(trim(decision)) AS d, same_probability AS p, confidence AS c FROM pair_decisions WHERE feature_b IS NOT NULL AND feature_a <> feature_b),
    f AS (SELECT a AS feature, b AS partner, d, p, c FROM p UNION ALL SELECT b, a, d, p, c FROM p)
    SELECT feature, partner, d AS decision, round(p, 6) AS probability FROM f QUALIFY row_number() OVER (PARTITION BY feature ORDER BY p DESC, c DESC, partner, d) = 1"""
)
def best_decision(spark: SparkSession, folder: str) -> DataFrame:
    """The most probable decision about each feature, ties by confidence and name."""
    p = table(spark, folder, "pair_decisions").where("feature_b is not null and feature_a <> feature_b").select("feature_a", "feature_b", F.upper(F.trim("decision")).alias("d"), "same_probability", "confidence")
    sides = F.explode(F.array(F.struct(F.col("feature_a").alias("f"), F.col("feature_b").alias("o")), F.struct(F.col("feature_b").alias("f"), F.col("feature_a").alias("o"))))
    rows = p.select(sides.alias("s"), "d", "same_probability", "confidence").select(F.col("s.f").alias("feature"), F.struct((-F.col("same_probability")).alias("p"), (-F.col("confidence")).alias("c"), F.col("s.o").alias("o"), "d").alias("x"))
    return rows.groupBy("feature").agg(F.min("x").alias("x")).select("feature", F.col("x.o").alias("partner"), F.col("x.d").alias("decision"), F.round(-F.col("x.p"), 6).alias("probability"))


@register("SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events QUALIFY gap_us > 3600000000")
def sequence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events that come more than an hour after the same user's previous one."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, folder, "events").select("event_id", "user_id", (micros - before).alias("gap_us")).where("gap_us > 3600000000")


@register("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_no FROM events")
def event_sequence(spark: SparkSession, folder: str) -> DataFrame:
    placed = ranking.ranked(table(spark, folder, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], "sequence_no")
    return placed.select("event_id", "user_id", "sequence_no")


@register(f"WITH {_EVIDENCE} SELECT document_id, round(max(score), 6) AS best, arg_min(evidence_id, struct_pack(s := -coalesce(score, 0), e := evidence_id)) AS first_evidence FROM evidence GROUP BY document_id")
def first_appearance(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct(-F.coalesce("score", F.lit(0.0)), F.col("evidence_id"))
    return evidence(spark, folder).groupBy("document_id").agg(F.round(F.max("score"), 6).alias("best"), F.min_by("evidence_id", order).alias("first_evidence"))


@register("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders WHERE round(o_totalprice, 2) < 100000.0 OR (round(o_totalprice, 2) = 100000.0 AND o_orderkey > 0) ORDER BY round(o_totalprice, 2) DESC, o_orderkey LIMIT 21")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))
    return ranking.page_after(rows, F.col("price"), 100000.0, F.col("o_orderkey"), 0, 20)


@register(
    f"""WITH {_CHUNKS}, m AS (SELECT document_id, max(ordinal)::BIGINT AS v FROM chunks GROUP BY 1), a AS (SELECT document_id, fact_count::BIGINT AS v FROM graph_index_results WHERE indexer_version = 'graph-index-v2')
    SELECT * FROM m WHERE document_id NOT IN (SELECT document_id FROM a) UNION ALL SELECT * FROM a"""
)
def generation_members(spark: SparkSession, folder: str) -> DataFrame:
    members = chunks(spark, folder).groupBy("document_id").agg(F.max("ordinal").cast("long").alias("v"))
    arrivals = table(spark, folder, "graph_index_results").where("indexer_version = 'graph-index-v2'").select("document_id", F.col("fact_count").cast("long").alias("v"))
    return snapshots.next_generation(members, arrivals, "document_id")


@register(
    f"""WITH {_EVIDENCE}, a AS (SELECT document_id, unnest(channels) AS backend, score FROM evidence)
    SELECT document_id FROM a WHERE backend IN ('dense', 'graph') AND score >= 0.3 GROUP BY document_id HAVING count(DISTINCT backend) = 2"""
)
def barrier_two_acks(spark: SparkSession, folder: str) -> DataFrame:
    acks = evidence(spark, folder).select("document_id", F.explode("channels").alias("backend"), "score")
    return snapshots.barrier(acks, "document_id", "backend", F.col("score") >= 0.3, ["dense", "graph"])


@register("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "content_hash", "copies")


@register(
    """WITH d AS (SELECT source, external_id, sha256(text) AS h, doc_id, retrieved_at FROM documents), k AS (SELECT source, external_id, h FROM d WHERE retrieved_at < TIMESTAMP '2024-07-01')
    SELECT source, external_id, h AS content_hash, min(doc_id) AS doc_id FROM d WHERE retrieved_at >= TIMESTAMP '2024-07-01' AND NOT EXISTS (SELECT 1 FROM k WHERE k.source = d.source AND k.external_id = d.external_id AND k.h = d.h) GROUP BY ALL"""
)
def idempotent_ingest(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("source", "external_id", F.sha2("text", 256).alias("content_hash"), "doc_id", "retrieved_at")
    cut_at = F.lit("2024-07-01").cast("timestamp_ntz")
    new = snapshots.new_only(d.where(F.col("retrieved_at") >= cut_at), d.where(F.col("retrieved_at") < cut_at), ["source", "external_id", "content_hash"], [F.col("doc_id")])
    return new.select("source", "external_id", "content_hash", "doc_id")


@register("SELECT canonical_name FROM technical_concepts EXCEPT SELECT canonical_name FROM concept_mentions")
def set_except(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "technical_concepts").select("canonical_name").subtract(table(spark, folder, "concept_mentions").select("canonical_name"))


@register("SELECT canonical_name FROM technical_concepts INTERSECT SELECT target_text FROM graph_candidates")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "technical_concepts").select("canonical_name").intersect(table(spark, folder, "graph_candidates").select("target_text"))


@register(
    """WITH a AS (SELECT unnest([canonical_name, surface_text]) AS name FROM concept_mentions), l AS (SELECT canonical_name AS name FROM concept_mentions EXCEPT ALL SELECT surface_text FROM concept_mentions), r AS (SELECT surface_text AS name FROM concept_mentions EXCEPT ALL SELECT canonical_name FROM concept_mentions)
    SELECT name, 'left' AS side FROM l UNION ALL SELECT name, 'right' FROM r"""
)
def set_equality(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "concept_mentions")
    return snapshots.symmetric_difference(m.select(F.col("canonical_name").alias("name")), m.select(F.col("surface_text").alias("name")))


@register(f"WITH {_EVIDENCE} SELECT document_id, array_to_string(list_sort(list_distinct(flatten(list(channels)))), ',') AS channels, count(*) AS n FROM evidence GROUP BY document_id")
def channel_union(spark: SparkSession, folder: str) -> DataFrame:
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_set("channels"))))
    return evidence(spark, folder).groupBy("document_id").agg(F.array_join(both, ",").alias("channels"), F.count("*").alias("n"))


@register(
    f"""WITH {_CHUNKS}, {_CANDIDATES}, b AS (SELECT c.chunk_id, coalesce(g.span_start, length(c.text)) AS s, coalesce(g.span_end, length(c.text)) AS e FROM chunks c JOIN candidates g ON g.evidence_chunk_id = c.chunk_id WHERE g.span_start < g.span_end
      UNION ALL SELECT chunk_id, length(text), length(text) FROM chunks), r AS (SELECT chunk_id, s, coalesce(max(e) OVER (PARTITION BY chunk_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM b)
    SELECT chunk_id, sum(n)::BIGINT AS uncovered, count(*) AS gaps FROM (SELECT DISTINCT r.chunk_id, r.reach, r.s, r.s - r.reach AS n, c.text FROM r JOIN chunks c USING (chunk_id) WHERE s > reach)
    WHERE regexp_replace(substr(text, reach + 1, n), '\\s+', '', 'g') <> '' GROUP BY chunk_id"""
)
def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each chunk no candidate span covers."""
    c = chunks(spark, folder).select("chunk_id", "text")
    s = candidates(spark, folder).select(F.col("evidence_chunk_id").alias("chunk_id"), "span_start", "span_end").join(c.select("chunk_id"), "chunk_id", "left_semi")
    gaps = spans.uncovered(c, "chunk_id", "text", s, "span_start", "span_end")
    return gaps.groupBy("chunk_id").agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("uncovered"), F.count("*").alias("gaps"))


QUERIES, ORACLE = register.queries, register.sql
