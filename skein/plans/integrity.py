"""Integrity of annotated corpora: structural rules over all tables, drift against a snapshot, patches, signatures, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.io import table
from skein.operators import rules, snapshots
from skein.operators.ranking import ranked
from skein.plans.pipelines import RELATION_TAILS
from skein.plans.registry import Register
from skein.plans.relational import _ASSERTIONS, _CHUNKS, _EVIDENCE, _MENTIONS, assertions, chunks, event_sequence, evidence, mentions
from skein.session import shared_folder
from skein.streaming import events as ev

register = Register()

# The vocabularies of annotations.
KINDS = "ANALYTE APPLICATION DEVICE MATERIAL MECHANISM MORPHOLOGY OPERATING_CONDITION OTHER PERFORMANCE PROCESS PROPERTY TECHNOLOGY".split()
RELATIONS = "ACTS_ON CHANGES_PARAMETER DEPENDS_ON FABRICATED_BY FUNCTIONS_AS HAS_COMPONENT HAS_MECHANISM HAS_MORPHOLOGY HAS_PERFORMANCE HAS_PROPERTY INTEGRATED_IN MECHANISM_INVOLVES USED_FOR USES_MATERIAL".split()
POLARITIES = "POSITIVE NEGATIVE UNKNOWN".split()
MODALITIES = "ASSERTED COMPARED HYPOTHETICAL PROPOSED".split()
SUPPORT = "SUPPORTED CONTRADICTED INSUFFICIENT UNRESOLVED".split()
QUALIFIERS = "TEMPERATURE VOLTAGE PRESSURE LENGTH DURATION RESISTANCE CONCENTRATION HUMIDITY".split()
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
NUMBER = r"^-?\d+(\.\d+)?$"

_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_ALLOWED = " OR ".join(f"(relation_type = '{r}' AND t.concept_type IN ({_list(ts)}))" for r, ts in RELATION_TAILS.items())

#: rule: its condition in SQL, by the rows it is judged on. The Spark conditions below have the same names.
_SQL_RULES = {
    "m": {
        "MENTION_ID": f"NOT regexp_matches(mention_id, '{UUID}')", "MENTION_CHUNK_UNKNOWN": "text IS NULL", "MENTION_OFFSETS": "NOT (start_offset >= 0 AND start_offset < end_offset AND end_offset <= length(text))",
        "MENTION_SURFACE": "substr(text, start_offset + 1, end_offset - start_offset) <> surface_text", "MENTION_KIND": f"concept_type IS NULL OR concept_type NOT IN ({_list(KINDS)})", "MENTION_NAME": "coalesce(trim(canonical_name), '') = ''",
        "MENTION_QUOTE": "NOT contains(text, quote)", "MENTION_SURFACE_QUOTE": "NOT contains(quote, surface_text)", "MENTION_CONFIDENCE": "confidence IS NULL OR NOT (confidence BETWEEN 0 AND 1)", "MENTION_DELETED": "deleted_at IS NOT NULL",
    },
    "a": {
        "ASSERTION_ID": f"NOT regexp_matches(assertion_id, '{UUID}')", "HEAD_UNKNOWN": "h.mention_id IS NULL", "TAIL_UNKNOWN": "t.mention_id IS NULL", "ENDS_EQUAL": "head_mention_id = tail_mention_id", "RELATION_UNKNOWN": f"relation_type IS NULL OR relation_type NOT IN ({_list(RELATIONS)})",
        "POLARITY": f"polarity IS NULL OR polarity NOT IN ({_list(POLARITIES)})", "MODALITY": f"modality IS NULL OR modality NOT IN ({_list(MODALITIES)})", "SUPPORT": f"support_status IS NULL OR support_status NOT IN ({_list(SUPPORT)})",
        "TAIL_KIND": f"relation_type IN ({_list(RELATION_TAILS)}) AND t.mention_id IS NOT NULL AND NOT coalesce({_ALLOWED}, false)", "ENDS_APART": "h.chunk_id <> t.chunk_id", "HEAD_OUTSIDE": "h.start_offset >= t.start_offset AND h.end_offset <= t.end_offset AND h.chunk_id = t.chunk_id",
        "QUALIFIER_TYPE": f"qualifier_type NOT IN ({_list(QUALIFIERS)})", "QUALIFIER_EMPTY": "qualifier_type IS NOT NULL AND raw_text IS NULL AND raw_value IS NULL", "QUALIFIER_UNTYPED": "qualifier_type IS NULL AND (raw_value IS NOT NULL OR raw_text IS NOT NULL)",
        "QUALIFIER_UNIT": "unit <> '' AND NOT contains(raw_text, unit)", "QUALIFIER_VALUE": f"regexp_matches(raw_value, '{NUMBER}') AND NOT list_contains(list_transform(regexp_extract_all(replace(raw_text, '−', '-'), '-?\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE), TRY_CAST(raw_value AS DOUBLE))",
        "SUPPORTED_DENIAL": "polarity = 'NEGATIVE' AND support_status = 'SUPPORTED' AND modality = 'HYPOTHETICAL'",
    },
    "i": {
        "IDENTITY_LABEL": "decision IS NULL OR upper(trim(decision)) NOT IN ('SAME', 'DIFFERENT', 'UNCERTAIN')", "IDENTITY_SPELLING": "decision <> upper(trim(decision))", "IDENTITY_END": "feature_a IS NULL OR feature_b IS NULL", "IDENTITY_SELF": "feature_a = feature_b", "IDENTITY_PROBABILITY": "NOT (same_probability BETWEEN 0 AND 1)",
    },
    "s": {
        "SPAN_LENGTH": "evidence.span_end - evidence.span_start <> length(evidence.text)", "SPAN_ORDER": "NOT (evidence.span_start >= 0 AND evidence.span_start < evidence.span_end)", "SPAN_OVERLAP": "evidence.span_start < max(evidence.span_end) OVER (PARTITION BY evidence.chunk_id ORDER BY evidence.span_start, evidence.span_end, sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "SPAN_COUNT": "accepted_assertions IS NULL", "SPAN_REVIEW": "review_status IS NULL OR review_status = 'NOT_REVIEWED'",
    },
    "c": {
        "CHUNK_ID": f"NOT regexp_matches(chunk_id, '{UUID}')", "CHUNK_EMPTY": "coalesce(trim(text), '') = ''", "CHUNK_LANGUAGE": "language IS NULL OR NOT regexp_matches(language, '^[a-z]{2}$')", "CHUNK_GONE": "deleted_at < received_at", "CHUNK_LONG": "length(text) > 1200",
    },
}
_SQL_ROWS = {
    "m": f"WITH {_MENTIONS}, {_CHUNKS} SELECT m.*, c.text FROM mentions m LEFT JOIN chunks c USING (chunk_id)",
    "a": f"WITH {_ASSERTIONS}, {_MENTIONS} SELECT a.*, h, t FROM assertions a LEFT JOIN mentions h ON h.mention_id = a.head_mention_id LEFT JOIN mentions t ON t.mention_id = a.tail_mention_id",
    "i": "SELECT * FROM pair_decisions",
    "s": "SELECT * FROM sentence_audit",
    "c": "SELECT * FROM graph_chunks",
}


def _rules_sql() -> str:
    parts = []
    for name, found in _SQL_RULES.items():
        cases = ", ".join(f"CASE WHEN {condition} THEN '{rule}' END" for rule, condition in found.items())
        parts.append(f"SELECT unnest([{cases}]) AS rule FROM ({_SQL_ROWS[name]})")
    return "SELECT rule, count(*) AS broken FROM (" + " UNION ALL ".join(parts) + ") WHERE rule IS NOT NULL GROUP BY rule"


def _broken(rows: DataFrame, found: dict[str, Column]) -> DataFrame:
    """rule, broken: partial counts of every rule over rows, in one pass."""
    names = F.array(*[F.when(condition, F.lit(rule)) for rule, condition in found.items()])
    return rows.select(F.explode(names).alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("broken"))


@register(_rules_sql())
def annotation_rules(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows break each structural rule of the annotations and of what they refer to; rules that nobody breaks are absent."""
    c = F.col
    m = mentions(spark, folder).join(chunks(spark, folder).select("chunk_id", "text"), "chunk_id", "left")
    ends = mentions(spark, folder).select("mention_id", "chunk_id", "concept_type", "start_offset", "end_offset")
    end = lambda side: ends.select(c("mention_id").alias(f"{side}_mention_id"), F.struct("*").alias(side))
    a = assertions(spark, folder).join(end("head"), "head_mention_id", "left").join(end("tail"), "tail_mention_id", "left")
    allowed = F.lit(False)
    for relation, kinds in RELATION_TAILS.items():
        allowed |= (c("relation_type") == relation) & c("tail.concept_type").isin(kinds)
    outside = lambda name, values: c(name).isNull() | ~c(name).isin(values)
    numbers = F.transform(F.regexp_extract_all(F.replace("raw_text", F.lit("−"), F.lit("-")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    before = Window.partitionBy("evidence.chunk_id").orderBy("evidence.span_start", "evidence.span_end", "sentence_id").rowsBetween(Window.unboundedPreceding, -1)
    audit = table(spark, folder, "sentence_audit").withColumn("reached", F.max("evidence.span_end").over(before))
    parts = [
        (m, {
            "MENTION_ID": ~c("mention_id").rlike(UUID), "MENTION_CHUNK_UNKNOWN": c("text").isNull(), "MENTION_OFFSETS": ~((c("start_offset") >= 0) & (c("start_offset") < c("end_offset")) & (c("end_offset") <= F.char_length("text"))),
            "MENTION_SURFACE": F.substring(c("text"), c("start_offset") + 1, c("end_offset") - c("start_offset")) != c("surface_text"), "MENTION_KIND": outside("concept_type", KINDS), "MENTION_NAME": F.coalesce(F.trim("canonical_name"), F.lit("")) == "",
            "MENTION_QUOTE": ~F.contains("text", "quote"), "MENTION_SURFACE_QUOTE": ~F.contains("quote", "surface_text"), "MENTION_CONFIDENCE": c("confidence").isNull() | ~c("confidence").between(0, 1), "MENTION_DELETED": c("deleted_at").isNotNull(),
        }),
        (a, {
            "ASSERTION_ID": ~c("assertion_id").rlike(UUID), "HEAD_UNKNOWN": c("head").isNull(), "TAIL_UNKNOWN": c("tail").isNull(), "ENDS_EQUAL": c("head_mention_id") == c("tail_mention_id"), "RELATION_UNKNOWN": outside("relation_type", RELATIONS),
            "POLARITY": outside("polarity", POLARITIES), "MODALITY": outside("modality", MODALITIES), "SUPPORT": outside("support_status", SUPPORT),
            "TAIL_KIND": c("relation_type").isin(list(RELATION_TAILS)) & c("tail").isNotNull() & ~F.coalesce(allowed, F.lit(False)), "ENDS_APART": c("head.chunk_id") != c("tail.chunk_id"),
            "HEAD_OUTSIDE": (c("head.start_offset") >= c("tail.start_offset")) & (c("head.end_offset") <= c("tail.end_offset")) & (c("head.chunk_id") == c("tail.chunk_id")),
            "QUALIFIER_TYPE": ~c("qualifier_type").isin(QUALIFIERS), "QUALIFIER_EMPTY": c("qualifier_type").isNotNull() & c("raw_text").isNull() & c("raw_value").isNull(), "QUALIFIER_UNTYPED": c("qualifier_type").isNull() & (c("raw_value").isNotNull() | c("raw_text").isNotNull()),
            "QUALIFIER_UNIT": (c("unit") != "") & ~F.contains("raw_text", "unit"), "QUALIFIER_VALUE": c("raw_value").rlike(NUMBER) & ~F.array_contains(numbers, c("raw_value").try_cast("double")),
            "SUPPORTED_DENIAL": (c("polarity") == "NEGATIVE") & (c("support_status") == "SUPPORTED") & (c("modality") == "HYPOTHETICAL"),
        }),
        (table(spark, folder, "pair_decisions"), {
            "IDENTITY_LABEL": c("decision").isNull() | ~F.upper(F.trim("decision")).isin("SAME", "DIFFERENT", "UNCERTAIN"), "IDENTITY_SPELLING": c("decision") != F.upper(F.trim("decision")), "IDENTITY_END": c("feature_a").isNull() | c("feature_b").isNull(),
            "IDENTITY_SELF": c("feature_a") == c("feature_b"), "IDENTITY_PROBABILITY": ~c("same_probability").between(0, 1),
        }),
        (audit, {
            "SPAN_LENGTH": c("evidence.span_end") - c("evidence.span_start") != F.char_length("evidence.text"), "SPAN_ORDER": ~((c("evidence.span_start") >= 0) & (c("evidence.span_start") < c("evidence.span_end"))), "SPAN_OVERLAP": c("evidence.span_start") < c("reached"),
            "SPAN_COUNT": c("accepted_assertions").isNull(), "SPAN_REVIEW": c("review_status").isNull() | (c("review_status") == "NOT_REVIEWED"),
        }),
        (table(spark, folder, "graph_chunks"), {
            "CHUNK_ID": ~c("chunk_id").rlike(UUID), "CHUNK_EMPTY": F.coalesce(F.trim("text"), F.lit("")) == "", "CHUNK_LANGUAGE": c("language").isNull() | ~c("language").rlike("^[a-z]{2}$"), "CHUNK_GONE": c("deleted_at") < c("received_at"), "CHUNK_LONG": F.char_length("text") > 1200,
        }),
    ]
    out = None
    for rows, found in parts:
        part = _broken(rows, found)
        out = part if out is None else out.unionByName(part)
    return out


_THEN = "TIMESTAMP '2024-06-01'"


@register(
    f"""WITH p AS (SELECT chunk_id, arg_max(struct_pack(t := text, s := section, r := revision_id), received_at) FILTER (received_at < {_THEN}) AS b, arg_max(struct_pack(t := text || CASE WHEN substr(chunk_id, 1, 1) = '3' THEN '*' ELSE '' END, s := section, r := CASE WHEN substr(chunk_id, 1, 1) = '4' THEN '' ELSE revision_id END), received_at) AS n, max(deleted_at) AS gone FROM graph_chunks GROUP BY chunk_id)
    SELECT CASE WHEN b IS NULL THEN 'ADDED' WHEN gone IS NOT NULL THEN 'REMOVED' WHEN b.r <> n.r THEN 'REVISION_CHANGED' WHEN b.t <> n.t THEN 'TEXT_CHANGED' WHEN b.s <> n.s THEN 'SECTION_CHANGED' ELSE 'SAME' END AS drift, count(*) AS chunks FROM p GROUP BY 1"""
)
def snapshot_drift(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the chunks of a snapshot: the first difference of each from the present state, some of which is altered by id."""
    at, first = F.lit("2024-06-01").cast("timestamp_ntz"), F.substring("chunk_id", 1, 1)
    c = table(spark, folder, "graph_chunks")
    now = F.struct(F.concat("text", F.when(first == "3", "*").otherwise("")).alias("t"), F.col("section").alias("s"), F.when(first == "4", "").otherwise(F.col("revision_id")).alias("r"))
    then = F.struct(F.col("text").alias("t"), F.col("section").alias("s"), F.col("revision_id").alias("r"))
    p = c.groupBy("chunk_id").agg(F.max_by(then, F.when(F.col("received_at") < at, F.col("received_at"))).alias("b"), F.max(F.col("received_at") < at).alias("known"), F.max_by(now, "received_at").alias("n"), F.max("deleted_at").alias("gone"))
    drift = (
        F.when(~F.col("known"), "ADDED").when(F.col("gone").isNotNull(), "REMOVED").when(F.col("b.r") != F.col("n.r"), "REVISION_CHANGED").when(F.col("b.t") != F.col("n.t"), "TEXT_CHANGED").when(F.col("b.s") != F.col("n.s"), "SECTION_CHANGED").otherwise("SAME")
    )
    return p.groupBy(drift.alias("drift")).agg(F.count("*").alias("chunks"))


@register(
    f"WITH {_EVIDENCE}, live AS (SELECT DISTINCT chunk_id, revision_id, document_id FROM graph_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM graph_chunks WHERE deleted_at IS NOT NULL)), k AS (SELECT source, evidence_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, evidence_id) AS place FROM evidence e WHERE score IS NOT NULL AND EXISTS (SELECT 1 FROM live l WHERE l.chunk_id = e.chunk_id AND l.revision_id = e.revision_id AND l.document_id = e.document_id)) SELECT * FROM k WHERE place <= 20"
)
def surviving_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The best 20 hits of each source that still exist: verified before the limit, so that no page comes out short."""
    c = table(spark, folder, "graph_chunks")
    live = c.join(c.where("deleted_at is not null").select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "revision_id", "document_id").distinct()
    hits = evidence(spark, folder).where("score is not null").join(live, ["chunk_id", "revision_id", "document_id"], "left_semi").select("source", "evidence_id", "score")
    w = Window.partitionBy("source").orderBy(F.col("score").desc(), "evidence_id")
    return hits.withColumn("place", F.row_number().over(w)).where("place <= 20")


@register(
    """WITH p AS (SELECT least(feature_a, feature_b) AS a, greatest(feature_a, feature_b) AS b, max(struct_pack(t := decided_at, d := upper(trim(decision)), p := same_probability, c := confidence)) AS l FROM pair_decisions WHERE feature_b IS NOT NULL AND feature_a <> feature_b AND decision IS NOT NULL AND decided_at IS NOT NULL GROUP BY ALL),
    n AS (SELECT f, count(*) AS n FROM (SELECT a AS f FROM p UNION ALL SELECT b FROM p) GROUP BY f)
    SELECT p.a, p.b, l.d AS decision, x.n AS a_pairs, y.n AS b_pairs, l.d || CASE WHEN l.p IS NULL THEN ' without a probability' WHEN l.d = 'SAME' AND l.p < 0.5 OR l.d = 'DIFFERENT' AND l.p > 0.5 THEN ' against its probability' ELSE ' as its probability says' END || CASE WHEN coalesce(l.c, 0) < 0.7 THEN ', unsure' ELSE ', sure' END AS reason
    FROM p JOIN n x ON x.f = p.a JOIN n y ON y.f = p.b"""
)
def pair_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The latest decision of every pair with what each side takes part in, and a reason in words."""
    p = table(spark, folder, "pair_decisions").where("feature_b is not null and feature_a <> feature_b and decision is not null and decided_at is not null")
    last = F.max(F.struct(F.col("decided_at").alias("t"), F.upper(F.trim("decision")).alias("d"), F.col("same_probability").alias("p"), F.col("confidence").alias("c"))).alias("l")
    pairs = p.groupBy(F.least("feature_a", "feature_b").alias("a"), F.greatest("feature_a", "feature_b").alias("b")).agg(last)
    side = pairs.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    j = pairs.join(side.select(F.col("f").alias("a"), F.col("n").alias("a_pairs")), "a").join(side.select(F.col("f").alias("b"), F.col("n").alias("b_pairs")), "b")
    against = ((F.col("l.d") == "SAME") & (F.col("l.p") < 0.5)) | ((F.col("l.d") == "DIFFERENT") & (F.col("l.p") > 0.5))
    said = F.when(F.col("l.p").isNull(), " without a probability").when(against, " against its probability").otherwise(" as its probability says")
    return j.select("a", "b", F.col("l.d").alias("decision"), "a_pairs", "b_pairs", F.concat("l.d", said, F.when(F.coalesce("l.c", F.lit(0.0)) < 0.7, ", unsure").otherwise(", sure")).alias("reason"))


_CASES = " ".join(f"WHEN {condition} THEN '{name}'" for name, condition in rules.RELATION_RULES)


@register(f"WITH p AS (SELECT upper(trim(decision)) = 'DIFFERENT' AS c, same_probability >= 0.9 AS a, same_probability >= 0.5 AND same_probability < 0.98 AS s, confidence >= 0.6 AS r FROM pair_decisions) SELECT CASE {_CASES} ELSE 'none' END AS relation, count(*) AS pairs FROM p GROUP BY 1")
def relation_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Four answers for every decided pair, put together to a relation or rejected as contradictory."""
    p, q = table(spark, folder, "pair_decisions"), F.col("same_probability")
    answers = {"c": F.upper(F.trim("decision")) == "DIFFERENT", "a": q >= 0.9, "s": (q >= 0.5) & (q < 0.98), "r": F.col("confidence") >= 0.6}
    return p.groupBy(rules.relation_of(answers).alias("relation")).agg(F.count("*").alias("pairs"))


@register(
    f"""WITH {_EVIDENCE}, {_CHUNKS}, e AS (SELECT evidence_id, external_id || CASE WHEN substr(evidence_id, 1, 2) = '00' THEN '?' ELSE '' END AS external_id, source, coalesce(title, '') || CASE WHEN substr(evidence_id, 1, 1) = '5' THEN '.' ELSE '' END AS title, chunk_id, revision_id, text || CASE WHEN substr(evidence_id, 1, 1) = '6' THEN '~' ELSE '' END AS text, channels, score FROM evidence WHERE external_id IS NOT NULL),
    n AS (SELECT evidence_id, count(*) AS n FROM candidate_evidence GROUP BY 1), q AS (SELECT evidence_chunk_id AS chunk_id, bool_or(NOT contains(c.text, g.quote)) AS made_up FROM graph_candidates g JOIN chunks c ON c.chunk_id = g.evidence_chunk_id GROUP BY 1),
    o AS (SELECT e.external_id, unnest([CASE WHEN n.n > 1 THEN 'DUPLICATE_EVIDENCE' END, CASE WHEN d.external_id IS NULL THEN 'UNKNOWN_SOURCE' END, CASE WHEN d.external_id IS NOT NULL AND (e.source <> d.source OR e.title <> coalesce(d.title, '')) THEN 'SOURCE_METADATA_MISMATCH' END, CASE WHEN e.revision_id <> c.revision_id THEN 'SOURCE_REVISION_MISMATCH' END,
      CASE WHEN NOT contains(c.text, e.text) THEN 'EVIDENCE_SPAN_MISMATCH' END, CASE WHEN e.chunk_id IS NOT NULL AND c.chunk_id IS NULL THEN 'PHANTOM_CITATION' END, CASE WHEN q.made_up THEN 'FABRICATED_QUOTE' END, CASE WHEN e.chunk_id IS NULL THEN 'INVALID_CITATION' END, CASE WHEN coalesce(len(e.channels), 0) = 0 THEN 'COVERAGE_MISMATCH' END, CASE WHEN e.score IS NULL THEN 'MISSING_RESULT' END, '']) AS code
      FROM e JOIN n USING (evidence_id) LEFT JOIN documents d ON d.external_id = e.external_id LEFT JOIN chunks c ON c.chunk_id = e.chunk_id LEFT JOIN q ON q.chunk_id = e.chunk_id)
    SELECT external_id, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (code <> ''), '') AS errors FROM o WHERE code IS NOT NULL GROUP BY external_id"""
)
def observation_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The error codes of each source's evidence, checked against documents, chunks and quotes; copies are spoilt by their ids first."""
    first, c = F.substring("evidence_id", 1, 1), chunks(spark, folder)
    mark = lambda at, value: F.when(at, value).otherwise("")
    e = evidence(spark, folder).where("external_id is not null").select(
        "evidence_id", F.concat("external_id", mark(F.substring("evidence_id", 1, 2) == "00", "?")).alias("external_id"), "source", F.concat(F.coalesce("title", F.lit("")), mark(first == "5", ".")).alias("title"), "chunk_id", "revision_id", F.concat("text", mark(first == "6", "~")).alias("text"), "channels", "score"
    )
    n = table(spark, folder, "candidate_evidence").groupBy("evidence_id").agg(F.count("*").alias("n"))
    quotes = table(spark, folder, "graph_candidates").select(F.col("evidence_chunk_id").alias("chunk_id"), "quote").join(c.select("chunk_id", "text"), "chunk_id").groupBy("chunk_id").agg(F.max(~F.contains("text", "quote")).alias("made_up"))
    d = table(spark, folder, "documents").where("external_id is not null").select("external_id", F.col("source").alias("d_source"), F.coalesce("title", F.lit("")).alias("d_title"), F.lit(True).alias("known"))
    j = e.join(n, "evidence_id").join(d, "external_id", "left").join(c.select("chunk_id", F.col("revision_id").alias("c_revision"), F.col("text").alias("c_text"), F.lit(True).alias("met")), "chunk_id", "left").join(quotes, "chunk_id", "left")
    codes = {
        "DUPLICATE_EVIDENCE": F.col("n") > 1, "UNKNOWN_SOURCE": F.col("known").isNull(), "SOURCE_METADATA_MISMATCH": (F.col("source") != F.col("d_source")) | (F.col("title") != F.col("d_title")), "SOURCE_REVISION_MISMATCH": F.col("revision_id") != F.col("c_revision"),
        "EVIDENCE_SPAN_MISMATCH": ~F.contains("c_text", "text"), "PHANTOM_CITATION": F.col("chunk_id").isNotNull() & F.col("met").isNull(), "FABRICATED_QUOTE": F.col("made_up"), "INVALID_CITATION": F.col("chunk_id").isNull(), "COVERAGE_MISMATCH": F.coalesce(F.size("channels"), F.lit(0)) <= 0, "MISSING_RESULT": F.col("score").isNull(),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in codes.items()]), lambda x: x.isNotNull())
    return j.select("external_id", F.explode_outer(found).alias("code")).groupBy("external_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("errors"))


_KEY = "page-key"


def _hmac_sql(message: str) -> str:
    pad = lambda x: "from_hex('" + bytes(b ^ x for b in _KEY.encode().ljust(64, b"\0")).hex() + "')"
    return f"sha256({pad(0x5C)} || from_hex(sha256({pad(0x36)} || ({message})::BLOB)))"


@register(
    f"WITH p AS (SELECT applicant_key, row_number() OVER (PARTITION BY applicant_key ORDER BY document_id) AS n, document_id FROM documents WHERE applicant_key IS NOT NULL), s AS (SELECT *, {_hmac_sql("applicant_key || '|' || document_id")} AS signature FROM p WHERE n % 10 = 0) SELECT applicant_key, document_id AS after, signature, {_hmac_sql("'other' || '|' || document_id")} <> signature AS bound FROM s"
)
def signed_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """Cursors behind every tenth document of an owner, signed for that owner; for another owner the signature differs."""
    d = ranked(table(spark, folder, "documents").where("applicant_key is not null").select("applicant_key", "document_id"), ["applicant_key"], [F.col("document_id")], "n").where("n % 10 = 0")
    sign = lambda owner: tx.hmac_sha256(F.concat_ws("|", owner, "document_id"), _KEY.encode())
    return d.select("applicant_key", F.col("document_id").alias("after"), sign(F.col("applicant_key")).alias("signature"), (sign(F.lit("other")) != sign(F.col("applicant_key"))).alias("bound"))


@register(
    "WITH l AS (SELECT chunk_id, mention_id, arg_max(struct_pack(n := canonical_name, d := deleted_at IS NOT NULL), received_at) AS x FROM (SELECT * FROM concept_mentions WHERE chunk_id IS NOT NULL AND canonical_name IS NOT NULL) GROUP BY ALL) SELECT chunk_id, count(*) FILTER (NOT x.d) AS entries, md5(coalesce(string_agg(x.n, '|' ORDER BY mention_id) FILTER (NOT x.d), '')) AS state FROM l GROUP BY chunk_id"
)
def patch_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The names of a chunk's mentions after its patches are replayed in order: a delivery sets an entry, a deletion removes it."""
    m = table(spark, folder, "concept_mentions").where("chunk_id is not null and canonical_name is not null")
    # a chunk has as many patches as deliveries of its mentions
    patches = m.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("received_at", "mention_id", F.when(F.col("deleted_at").isNull(), F.col("canonical_name")).alias("name")))).alias("p"))
    state = patches.select("chunk_id", F.map_filter(snapshots.replayed("p", "mention_id", "name"), lambda k, v: v.isNotNull()).alias("s"))
    entries = F.array_sort(F.map_entries("s"))
    return state.select("chunk_id", F.size("s").cast("long").alias("entries"), F.md5(F.array_join(F.transform(entries, lambda e: e["value"]), "|")).alias("state"))


@register(
    f"WITH {_EVIDENCE}, l AS (SELECT document_id, evidence_id, '- ' || upper(coalesce(section, '?')) || ': ' || coalesce(title, '') AS line FROM evidence WHERE document_id IS NOT NULL) SELECT document_id, count(*) AS lines, sha256('# ' || document_id || chr(10) || string_agg(line, chr(10) ORDER BY evidence_id)) AS hash FROM l GROUP BY document_id"
)
def rendered_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of each document as a text that is always the same, and its hash."""
    line = F.concat(F.lit("- "), F.upper(F.coalesce("section", F.lit("?"))), F.lit(": "), F.coalesce("title", F.lit("")))
    e = evidence(spark, folder).where("document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", line.alias("line")))).alias("l"))
    body = F.concat(F.lit("# "), "document_id", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return e.select("document_id", F.size("l").cast("long").alias("lines"), F.sha2(body, 256).alias("hash"))


#: Seconds that entries of a layer live.
LIVES = {"view": 3600, "click": 86_400, "purchase": 604_800}
_LIFE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIVES.items()) + " ELSE 600 END"


@register(f"WITH x AS (SELECT event_type, user_id, max(epoch_us(ts) // 1000000) AS put FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL) SELECT event_type AS layer, count(*) FILTER (put + {_LIFE} > epoch_us(TIMESTAMP '2024-01-20') // 1000000) AS alive, count(*) AS entries FROM x GROUP BY event_type")
def layer_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of each layer, once for each key, that are still alive at a moment; every layer has its own life."""
    put = F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("put")
    x = table(spark, folder, "events").where("ts < timestamp_ntz '2024-01-20'").groupBy("event_type", "user_id").agg(put)
    life = F.lit(600)
    for layer, seconds in LIVES.items():
        life = F.when(F.col("event_type") == layer, seconds).otherwise(life)
    now = F.unix_seconds(F.lit("2024-01-20").cast("timestamp"))
    return x.groupBy(F.col("event_type").alias("layer")).agg(F.count_if(F.col("put") + life > now).alias("alive"), F.count("*").alias("entries"))


@register("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), k AS (SELECT *, max(n) FILTER (n % 14 <> 7) OVER (PARTITION BY user_id) AS last FROM n)
    SELECT user_id::VARCHAR AS key, any_value(last) AS last, count(*) FILTER (n % 7 <> 0) AS seen, count(*) FILTER (n % 14 = 7 AND n < last) AS gaps, count(*) FILTER (n % 14 = 0) AS resets FROM k GROUP BY user_id HAVING any_value(last) IS NOT NULL""")
def sequence_resets(spark: SparkSession, folder: str) -> DataFrame:
    """A reducer over numbered events of which every seventh is lost; every second of these comes as a snapshot that resets the reader."""
    numbered = event_sequence(spark, folder).join(table(spark, folder, "events").select("event_id", "value"), "event_id").where("sequence_no % 14 <> 7").withColumn("snapshot", F.col("sequence_no") % 14 == 0)
    place = f"{shared_folder(spark, 'resets')}/rows"
    numbered.write.parquet(place)
    stream = spark.readStream.schema(numbered.schema).parquet(place)
    return ev.drained(ev.fold_sequences(stream, "user_id", "sequence_no", "value", "snapshot"), "fold", "update").select("key", "last", "seen", "gaps", "resets")


QUERIES, ORACLE = register.queries, register.sql
