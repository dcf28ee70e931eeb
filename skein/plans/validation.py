"""Rules, grounding checks and audits as rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.io import table
from skein.operators import rules, spans
from skein.operators.latest import newest
from skein.plans.registry import Register
from skein.plans.relational import _ASSERTIONS, _CANDIDATES, _CHUNKS, _EVIDENCE, _MENTIONS, assertions, candidates, chunks, evidence, mentions

register = Register()

#: Which labels an edge kind may join. Fixed values.
ENDPOINTS = [("Document", "DISCLOSES_FEATURE", "TechnicalFeature"), ("Document", "USES_TECHNOLOGY", "Technology")]
EDGE_KINDS = ["DISCLOSES_FEATURE", "USES_TECHNOLOGY"]


@register(f"WITH {_CANDIDATES}, {_CHUNKS} SELECT candidate_id, coalesce(g.span_start >= 0 AND g.span_start < g.span_end AND g.span_end <= length(c.text), false) AS sane FROM candidates g JOIN chunks c ON c.chunk_id = g.evidence_chunk_id")
def span_sanity(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).select(F.col("chunk_id").alias("evidence_chunk_id"), "text")
    return candidates(spark, folder).join(c, "evidence_chunk_id").select("candidate_id", spans.sane(F.col("span_start"), F.col("span_end"), F.col("text")).alias("sane"))


@register(
    f"""WITH {_CANDIDATES}, {_CHUNKS}, j AS (SELECT g.*, c.text FROM candidates g LEFT JOIN chunks c ON c.chunk_id = g.evidence_chunk_id)
    SELECT candidate_id, CASE WHEN text IS NULL THEN 'CHUNK_MISSING' WHEN edge_type NOT IN ('DISCLOSES_FEATURE', 'USES_TECHNOLOGY') THEN 'EDGE_TYPE_UNKNOWN' WHEN target_label IS NULL THEN 'LABEL_MISSING' WHEN confidence < 0.75 THEN 'CONFIDENCE_LOW' WHEN substr(text, span_start + 1, span_end - span_start) <> quote THEN 'QUOTE_MISMATCH'
      WHEN length(target_text) > 160 THEN 'TARGET_LONG' WHEN NOT contains(lower(quote), lower(target_text)) THEN 'TARGET_NOT_IN_QUOTE' ELSE 'OK' END AS reason FROM j"""
)
def fact_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The first reason for which a candidate fact is refused."""
    c = chunks(spark, folder).select(F.col("chunk_id").alias("evidence_chunk_id"), "text")
    j = candidates(spark, folder).join(c, "evidence_chunk_id", "left")
    reason = rules.first_reason([
        ("CHUNK_MISSING", F.col("text").isNull()),
        ("EDGE_TYPE_UNKNOWN", ~F.col("edge_type").isin(EDGE_KINDS)),
        ("LABEL_MISSING", F.col("target_label").isNull()),
        ("CONFIDENCE_LOW", F.col("confidence") < 0.75),
        ("QUOTE_MISMATCH", spans.slice_of(F.col("text"), F.col("span_start"), F.col("span_end")) != F.col("quote")),
        ("TARGET_LONG", F.char_length("target_text") > 160),
        ("TARGET_NOT_IN_QUOTE", ~F.contains(F.lower("quote"), F.lower("target_text"))),
    ])
    return j.select("candidate_id", reason.alias("reason"))


@register()
def durable_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted facts once per target and provenance, with recomputed keys."""
    ok = fact_validation(spark, folder).where("reason = 'OK'").select("candidate_id")
    g = candidates(spark, folder).join(ok, "candidate_id", "left_semi")
    to_key = F.concat(F.col("target_label"), F.lit(":"), tx.url_key(tx.folded("target_text")))
    provenance = F.sha2(F.concat_ws("\x1f", "evidence_chunk_id", F.col("span_start").cast("string"), F.col("span_end").cast("string"), "quote"), 256)
    keyed = g.select("candidate_id", to_key.alias("to_key"), provenance.alias("provenance_key"), "confidence").where(F.char_length("to_key") <= 512)
    return newest(keyed, ["to_key", "provenance_key"], -F.col("candidate_id")).select("candidate_id", "to_key", "provenance_key", F.sha2(F.concat_ws("|", "to_key", "provenance_key"), 256).alias("logical_hash"))


@register(f"WITH {_CANDIDATES} SELECT candidate_id, edge_type, coalesce(target_label, 'NONE') AS target_label FROM candidates WHERE NOT coalesce((edge_type = 'DISCLOSES_FEATURE' AND target_label = 'TechnicalFeature') OR (edge_type = 'USES_TECHNOLOGY' AND target_label = 'Technology'), false)")
def endpoint_rules(spark: SparkSession, folder: str) -> DataFrame:
    g = candidates(spark, folder).select("candidate_id", F.lit("Document").alias("source_label"), "edge_type", "target_label")
    return rules.endpoint_violations(g, "source_label", "edge_type", "target_label", ENDPOINTS).select("candidate_id", "edge_type", F.coalesce("target_label", F.lit("NONE")).alias("target_label"))


@register(
    f"""WITH {_MENTIONS}, {_CHUNKS}, j AS (SELECT m.*, c.text FROM mentions m LEFT JOIN chunks c USING (chunk_id))
    SELECT mention_id, CASE WHEN text IS NULL THEN 'CHUNK_MISSING' WHEN substr(text, start_offset + 1, end_offset - start_offset) <> surface_text THEN 'SLICE_MISMATCH' WHEN NOT contains(text, quote) THEN 'QUOTE_MISSING' WHEN NOT contains(quote, surface_text) THEN 'SURFACE_NOT_IN_QUOTE'
      WHEN confidence IS NULL THEN 'CONFIDENCE_MISSING' ELSE 'OK' END AS code FROM j"""
)
def grounding_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The first failed check of every mention against its chunk."""
    j = mentions(spark, folder).join(chunks(spark, folder).select("chunk_id", "text"), "chunk_id", "left")
    code = rules.first_reason([
        ("CHUNK_MISSING", F.col("text").isNull()),
        ("SLICE_MISMATCH", spans.slice_of(F.col("text"), F.col("start_offset"), F.col("end_offset")) != F.col("surface_text")),
        ("QUOTE_MISSING", ~F.contains("text", "quote")),
        ("SURFACE_NOT_IN_QUOTE", ~F.contains("quote", "surface_text")),
        ("CONFIDENCE_MISSING", F.col("confidence").isNull()),
    ])
    return j.select("mention_id", code.alias("code"))


@register(
    f"""WITH {_MENTIONS}, {_CHUNKS}, j AS (SELECT mention_id, text AS t, surface_text AS s, start_offset AS a, end_offset AS b, strpos(text, surface_text) - 1 AS p FROM mentions LEFT JOIN chunks USING (chunk_id)),
    k AS (SELECT *, CASE WHEN t IS NULL THEN 'TEXT_MISSING' WHEN s IS NULL OR s = '' THEN 'SURFACE_EMPTY' WHEN a >= 0 AND a < b AND substr(t, a + 1, b - a) = s THEN 'REPORTED' WHEN p < 0 THEN 'NOT_FOUND' WHEN strpos(substr(t, p + 2), s) > 0 THEN 'AMBIGUOUS' ELSE 'RECOVERED' END AS code FROM j)
    SELECT mention_id, CASE code WHEN 'REPORTED' THEN a WHEN 'RECOVERED' THEN p END::INTEGER AS start, CASE code WHEN 'REPORTED' THEN b WHEN 'RECOVERED' THEN p + length(s) END::INTEGER AS "end", code FROM k"""
)
def reanchored_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Where each mention stands in its chunk: as reported, recovered, or refused with a reason."""
    j = mentions(spark, folder).join(chunks(spark, folder).select("chunk_id", "text"), "chunk_id", "left")
    a = j.select("mention_id", rules.reanchored("text", "surface_text", "start_offset", "end_offset").alias("a"))
    return a.select("mention_id", "a.start", "a.end", "a.code")


@register(
    """WITH p AS (SELECT DISTINCT feature_a, feature_b, upper(trim(decision)) AS decision, confidence, same_probability AS s FROM pair_decisions WHERE feature_b IS NOT NULL)
    SELECT feature_a, feature_b, decision, CASE WHEN decision = 'SAME' AND s < 0.5 THEN 'CONTRADICTION' WHEN decision = 'SAME' AND s >= 0.9 AND confidence >= 0.9 THEN 'MERGE' WHEN decision = 'DIFFERENT' THEN 'KEEP_APART' ELSE 'REVIEW' END AS action, count(*) AS n FROM p GROUP BY ALL"""
)
def decision_table(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pair_decisions").where("feature_b is not null").select("feature_a", "feature_b", F.upper(F.trim("decision")).alias("decision"), "confidence", F.col("same_probability").alias("s")).distinct()
    same, s = F.col("decision") == "SAME", F.col("s")
    action = F.when(same & (s < 0.5), "CONTRADICTION").when(same & (s >= 0.9) & (F.col("confidence") >= 0.9), "MERGE").when(F.col("decision") == "DIFFERENT", "KEEP_APART").otherwise("REVIEW")
    return p.groupBy("feature_a", "feature_b", "decision", action.alias("action")).agg(F.count("*").alias("n"))


@register("SELECT upper(trim(decision)) AS decision, count(*) AS n, count(*) FILTER (CASE WHEN upper(trim(decision)) = 'SAME' THEN same_probability >= 0.5 ELSE same_probability <= 0.5 END) AS valid FROM pair_decisions WHERE upper(trim(decision)) IN ('SAME', 'DIFFERENT') GROUP BY 1")
def probability_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Whether two-class probabilities are sound and have their maximum at the decision."""
    d = F.upper(F.trim("decision"))
    p = table(spark, folder, "pair_decisions").select(d.alias("decision"), F.create_map(F.lit("SAME"), "same_probability", F.lit("DIFFERENT"), 1 - F.col("same_probability")).alias("p")).where("decision in ('SAME', 'DIFFERENT')")
    return p.groupBy("decision").agg(F.count("*").alias("n"), F.count_if(rules.probabilities_valid(F.col("p"), ["SAME", "DIFFERENT"], F.col("decision"))).alias("valid"))


#: Pairs made of one name, for every rule of the veto and beside it: what stands before the name on either side.
VETO_PAIRS = [
    ("n-type ", "p type "), ("N type film of ", "p-type "), ("oxidation of ", "Reduction of CO by "), ("reduction in ", "oxidized "), ("high ", "low "), ("Increased ", "decreases "), ("with ", "without "), ("positive ", "negative "),
    ("NO2 with ", "NH3 and "), ("no 2 ", "nh 3 "), ("high ", "low doped "), ("n-type ", "n type "), ("with ", "with "), ("highly ", "lowly "), ("CO2 ", "NH3 "), ("notype ", "p-type "),
]
_MADE = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(VETO_PAIRS))
_HAS = lambda x, p: f"regexp_matches({x}, '{p}')"
_OPPOSED = lambda l, r: f"(({_HAS('a', l)} AND {_HAS('b', r)}) OR ({_HAS('a', r)} AND {_HAS('b', l)}))"  # noqa: E731, E741
_REST = lambda x, l, r: f"trim(regexp_replace(regexp_replace({x}, '{l}|{r}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"  # noqa: E731, E741
_CONTRAST = " OR ".join(f"({_OPPOSED(l, r)} AND {_REST('a', l, r)} <> '' AND {_REST('a', l, r)} = {_REST('b', l, r)})" for l, r in rules.CONTRASTS)  # noqa: E741
_VETO = {code: _OPPOSED(left, right) for code, left, right in rules.VETOES}


@register(
    f"""WITH made(i, x, y) AS (VALUES {_MADE}), p AS (SELECT i, lower(x || canonical_name) AS a, lower(y || canonical_name) AS b FROM technical_concepts, made
      UNION ALL SELECT DISTINCT -1, lower(feature_a), lower(feature_b) FROM pair_decisions WHERE feature_b IS NOT NULL)
    SELECT i AS made, CASE WHEN {_VETO['CARRIER_POLARITY']} THEN 'CARRIER_POLARITY' WHEN {_VETO['OXIDATION_REDUCTION']} THEN 'OXIDATION_REDUCTION' WHEN {_CONTRAST} THEN 'QUALIFIER' WHEN {_VETO['ANALYTE']} THEN 'ANALYTE' ELSE 'NONE' END AS reason, count(*) AS pairs
    FROM p GROUP BY ALL"""
)
def safety_veto(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that may never merge, by reason: of the decided pairs (made = -1), and of names made opposite in every way."""
    decided = table(spark, folder, "pair_decisions").where("feature_b is not null").select(F.lower("feature_a").alias("a"), F.lower("feature_b").alias("b")).distinct().select(F.lit(-1).alias("made"), "a", "b")
    pairs = F.array(*[F.struct(F.lit(i).alias("made"), F.concat(F.lit(x), "canonical_name").alias("a"), F.concat(F.lit(y), "canonical_name").alias("b")) for i, (x, y) in enumerate(VETO_PAIRS)])
    made = table(spark, folder, "technical_concepts").select(F.explode(pairs).alias("p")).select("p.*")
    both = decided.unionByName(made)
    return both.groupBy("made", F.coalesce(rules.veto_reason(F.col("a"), F.col("b")), F.lit("NONE")).alias("reason")).agg(F.count("*").alias("pairs"))


@register(
    f"""WITH {_ASSERTIONS}, v AS (SELECT assertion_id, unnest(list_filter([CASE WHEN head_mention_id IS NULL THEN 'HEAD_MISSING' END, CASE WHEN tail_mention_id IS NULL THEN 'TAIL_MISSING' END, CASE WHEN relation_type IS NULL THEN 'RELATION_MISSING' END,
      CASE WHEN relation_type <> upper(relation_type) THEN 'RELATION_CASE' END, CASE WHEN polarity = 'NEGATIVE' AND support_status = 'SUPPORTED' THEN 'NEGATIVE_SUPPORTED' END, CASE WHEN qualifier_type IS NULL AND raw_value IS NOT NULL THEN 'VALUE_WITHOUT_TYPE' END, CASE WHEN modality = 'HYPOTHETICAL' AND support_status = 'CONTRADICTED' THEN 'HYPOTHESIS_CONTRADICTED' END], lambda x: x IS NOT NULL)) AS rule FROM assertions)
    SELECT assertion_id, rule FROM v"""
)
def violation_rules(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return rules.violations(assertions(spark, folder), "assertion_id", {
        "HEAD_MISSING": c("head_mention_id").isNull(),
        "TAIL_MISSING": c("tail_mention_id").isNull(),
        "RELATION_MISSING": c("relation_type").isNull(),
        "RELATION_CASE": c("relation_type") != F.upper("relation_type"),
        "NEGATIVE_SUPPORTED": (c("polarity") == "NEGATIVE") & (c("support_status") == "SUPPORTED"),
        "VALUE_WITHOUT_TYPE": c("qualifier_type").isNull() & c("raw_value").isNotNull(),
        "HYPOTHESIS_CONTRADICTED": (c("modality") == "HYPOTHETICAL") & (c("support_status") == "CONTRADICTED"),
    })


@register(
    """SELECT 'graph_index_results' AS table_name, 'revision_unique' AS rule, (SELECT count(*) - count(DISTINCT revision_id) FROM graph_index_results) AS broken
    UNION ALL SELECT 'documents', 'doc_id_unique', (SELECT count(*) - count(DISTINCT doc_id) FROM documents) UNION ALL SELECT 'documents', 'n_chars_right', (SELECT count(*) FROM documents WHERE n_chars <> length(text))
    UNION ALL SELECT 'concept_mentions', 'offsets_ordered', (SELECT count(*) FROM concept_mentions WHERE NOT (start_offset >= 0 AND start_offset < end_offset)) UNION ALL SELECT 'pair_decisions', 'probability_range', (SELECT count(*) FROM pair_decisions WHERE NOT (same_probability BETWEEN 0 AND 1))"""
)
def constraint_checks(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows break each constraint; 0 everywhere on sound data."""
    t = lambda n: table(spark, folder, n)
    unique = lambda n, k: t(n).agg((F.count("*") - F.count_distinct(k)).alias("broken"))
    broken = lambda n, c: t(n).agg(F.count_if(c).alias("broken"))
    rows = [
        ("graph_index_results", "revision_unique", unique("graph_index_results", "revision_id")),
        ("documents", "doc_id_unique", unique("documents", "doc_id")),
        ("documents", "n_chars_right", broken("documents", F.col("n_chars") != F.char_length("text"))),
        ("concept_mentions", "offsets_ordered", broken("concept_mentions", ~((F.col("start_offset") >= 0) & (F.col("start_offset") < F.col("end_offset"))))),
        ("pair_decisions", "probability_range", broken("pair_decisions", ~F.col("same_probability").between(0, 1))),
    ]
    out = None
    for name, rule, r in rows:
        part = r.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "broken")
        out = part if out is None else out.unionByName(part)
    return out


@register(f"""WITH {_EVIDENCE}, {_CHUNKS}, e AS (SELECT evidence_id, chunk_id, document_id, CASE WHEN substr(evidence_id, 1, 1) IN ('0', '1') THEN '' ELSE revision_id END AS revision_id, CASE WHEN substr(evidence_id, 2, 1) = 'a' THEN upper(section) || '?' ELSE section END AS section, CASE WHEN substr(evidence_id, 1, 1) IN ('1', '2') THEN substr(text, 2) ELSE text END AS text FROM evidence)
    SELECT e.evidence_id, list_sort(list_filter([CASE WHEN e.document_id <> c.document_id THEN 'document_id' END, CASE WHEN e.revision_id <> c.revision_id THEN 'revision_id' END, CASE WHEN e.section <> c.section THEN 'section' END, CASE WHEN e.text <> c.text THEN 'text' END], lambda x: x IS NOT NULL))::VARCHAR AS differs FROM e JOIN chunks c USING (chunk_id) WHERE e.document_id <> c.document_id OR e.revision_id <> c.revision_id OR e.section <> c.section OR e.text <> c.text""")
def evidence_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose fields don't equal those of its chunk, and which. The tables agree, so copies are spoilt by their ids first."""
    fields = ["document_id", "revision_id", "section", "text"]
    c = chunks(spark, folder).select("chunk_id", *[F.col(f).alias(f"_{f}") for f in fields])
    first, second = F.substring("evidence_id", 1, 1), F.substring("evidence_id", 2, 1)
    spoilt = evidence(spark, folder).select(
        "evidence_id", "chunk_id", "document_id", F.when(first.isin("0", "1"), "").otherwise(F.col("revision_id")).alias("revision_id"),
        F.when(second == "a", F.concat(F.upper("section"), F.lit("?"))).otherwise(F.col("section")).alias("section"), F.when(first.isin("1", "2"), F.substr("text", F.lit(2))).otherwise(F.col("text")).alias("text"),
    )
    j = spoilt.join(c, "chunk_id")
    differs = F.array_sort(F.filter(F.array(*[F.when(F.col(f) != F.col(f"_{f}"), F.lit(f)) for f in fields]), lambda x: x.isNotNull()))
    return j.select("evidence_id", differs.alias("d")).where("size(d) > 0").select("evidence_id", F.concat(F.lit("["), F.array_join("d", ", "), F.lit("]")).alias("differs"))


@register("SELECT doc_id, starts_with(url, 'https://') AND regexp_matches(url, '^https://(example\\.org|data\\.example\\.net)(/|$)') AS allowed FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'http' ELSE 'https' END || '://' || CASE WHEN doc_id % 3 = 0 THEN 'data.example.net' WHEN doc_id % 7 = 0 THEN 'user@example.org' ELSE 'example.org' END || '/' || external_id AS url FROM documents)")
def url_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    url = F.concat(F.when(n % 4 == 0, "http").otherwise("https"), F.lit("://"), F.when(n % 3 == 0, "data.example.net").when(n % 7 == 0, "user@example.org").otherwise("example.org"), F.lit("/"), "external_id")
    d = table(spark, folder, "documents").select("doc_id", url.alias("u"))
    ok = (F.try_parse_url("u", F.lit("PROTOCOL")) == "https") & F.try_parse_url("u", F.lit("HOST")).isin("example.org", "data.example.net") & F.try_parse_url("u", F.lit("USERINFO")).isNull()
    return d.select("doc_id", F.coalesce(ok, F.lit(False)).alias("allowed"))


@register("SELECT revision_id, CASE WHEN extraction_seconds IS NULL THEN 'PENDING' ELSE 'DONE' END AS state, CASE WHEN extraction_seconds IS NOT NULL THEN fact_count::BIGINT ELSE -1 END AS facts FROM graph_index_results")
def terminal_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Results are shown for finished revisions only."""
    done = F.col("extraction_seconds").isNotNull()
    return table(spark, folder, "graph_index_results").select("revision_id", F.when(done, "DONE").otherwise("PENDING").alias("state"), F.when(done, F.col("fact_count").cast("long")).otherwise(-1).alias("facts"))


@register(f"WITH {_EVIDENCE}, {_CHUNKS} SELECT evidence_id, CASE WHEN chunk_id IS NULL THEN 'UNADDRESSED' WHEN chunk_id IN (SELECT chunk_id FROM chunks WHERE deleted_at IS NULL) THEN 'PRESENT' ELSE 'ABSENT' END AS presence FROM evidence")
def mandatory_match(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that must meet a live chunk, with the outcome named instead of dropped."""
    live = chunks(spark, folder).where("deleted_at is null").select("chunk_id", F.lit(True).alias("live"))
    j = evidence(spark, folder).select("evidence_id", "chunk_id").join(live, "chunk_id", "left")
    return j.select("evidence_id", F.when(F.col("chunk_id").isNull(), "UNADDRESSED").when(F.col("live"), "PRESENT").otherwise("ABSENT").alias("presence"))


QUERIES, ORACLE = register.queries, register.sql
