"""Scalar functions over the text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.io import table
from skein.operators import rules
from skein.plans.registry import Register
from skein.plans.relational import _CANDIDATES, _CHUNKS, candidates, chunks

register = Register()
_TERMS = r"list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}\p{M}]+'), lambda t: length(t) > 1)"


@register(f"SELECT doc_id, len({_TERMS}) AS terms, len(list_distinct({_TERMS})) AS distinct_terms FROM documents")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "documents").select("doc_id", tx.plain_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("terms"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"))


@register()
def compatible_terms(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "graph_candidates").select("candidate_id", tx.terms("target_text").alias("t"))
    return t.select("candidate_id", F.array_join("t", " ").alias("terms")).distinct()


@register(
    r"""SELECT DISTINCT cluster_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(canonical_text), '(\w)-(\w)', '\1 \2', 'g'), '[!"#$%&''()*,./:;<=>?@\[\\\]^_`{|}~]', ' ', 'g'), '\s+', ' ', 'g')) AS feature
    FROM feature_clusters"""
)
def normalize_feature(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "feature_clusters").select("cluster_id", tx.feature_text("canonical_text").alias("feature")).distinct()


@register()
def normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The forms a concept name is compared in: folded, composed, name and feature form."""
    names = table(spark, folder, "concept_mentions").select("canonical_name").where("canonical_name is not null").distinct()
    return names.select("canonical_name", tx.folded("canonical_name").alias("folded"), tx.composed("canonical_name").alias("composed"), tx.concept_text("canonical_name").alias("concept"), tx.feature_text("canonical_name").alias("feature"))


@register(
    """WITH u AS (SELECT doc_id, 'HTTPS://Example.ORG/' || source || '/' || external_id || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '?Q=A' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '#part' ELSE '' END AS url FROM documents)
    SELECT doc_id, 'https://example.org' || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/+$', '') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1) AS url FROM u"""
)
def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    end = lambda k, s: F.when(n % k == 0, s).otherwise("")
    url = F.concat(F.lit("HTTPS://Example.ORG/"), "source", F.lit("/"), "external_id", end(2, "/"), end(3, "?Q=A"), end(5, "#part"))
    return table(spark, folder, "documents").select("doc_id", tx.canonical_url(url).alias("url"))


@register(
    r"""SELECT doc_id, CASE WHEN source = 'epo_ops' AND regexp_full_match(upper(regexp_replace(external_id, '[\s.]', '', 'g')), '[A-Z]{2}[A-Z0-9]+[A-Z][0-9]?') THEN upper(regexp_replace(external_id, '[\s.]', '', 'g'))
    WHEN source = 'openalex' AND regexp_full_match(upper(string_split(trim(external_id), '/')[-1]), 'W[0-9]+') THEN upper(string_split(trim(external_id), '/')[-1]) END AS external_id FROM documents"""
)
def external_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.canonical_external_id(F.col("source"), F.col("external_id")).alias("external_id"))


@register(
    r"""WITH x AS (SELECT doc_id, lang, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) AS c FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(lang, '[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*') THEN lower(lang) WHEN l > 0 AND c / l > 0.25 THEN 'ru' ELSE 'und' END AS language FROM x"""
)
def language_guess(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.language_or_guess(F.col("lang"), F.col("text")).alias("language"))


@register("SELECT doc_id, sha256(text) AS content_hash, sha256(source || chr(31) || external_id) AS identity FROM documents")
def hash_identity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.sha2(F.concat_ws("\x1f", "source", "external_id"), 256).alias("identity"))


@register("SELECT DISTINCT target_text, replace(replace(rtrim(to_base64(encode(target_text)), '='), '+', '-'), '/', '_') AS key, true AS round_trip FROM graph_candidates WHERE target_text IS NOT NULL")
def feature_keys(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "graph_candidates").where("target_text is not null").select("target_text").distinct()
    key = tx.url_key(F.col("target_text"))
    return g.select("target_text", key.alias("key"), (tx.from_url_key(key) == F.col("target_text")).alias("round_trip"))


_SHA1 = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || canonical_key::BLOB)"
_VARIANT = f"substr('89ab', (strpos('0123456789abcdef', substr({_SHA1}, 17, 1)) - 1) % 4 + 1, 1)"


@register(f"SELECT DISTINCT cluster_id, CASE WHEN canonical_key IS NOT NULL THEN substr({_SHA1}, 1, 8) || '-' || substr({_SHA1}, 9, 4) || '-5' || substr({_SHA1}, 14, 3) || '-' || {_VARIANT} || substr({_SHA1}, 18, 3) || '-' || substr({_SHA1}, 21, 12) END AS feature_id FROM feature_clusters")
def named_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Name-based ids of clusters."""
    ident = tx.named_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    return table(spark, folder, "feature_clusters").select("cluster_id", ident("canonical_key").alias("feature_id")).distinct()


@register("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce(props->>'$.missing', 'none') AS missing FROM events")
def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@register("SELECT event_id, sha256('{\"k\":' || (props->>'$.k') || '}') AS state_hash FROM events")
def json_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of the canonical form of JSON text."""
    return table(spark, folder, "events").select("event_id", F.sha2(tx.json_canonical("props"), 256).alias("state_hash"))


@register("SELECT doc_id, strftime(publication_date, '%Y%m%d') AS compact, epoch_us(retrieved_at) AS retrieved_us, try_cast(lang AS DATE) IS NULL AS lang_is_no_date FROM documents")
def date_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.date_format("publication_date", "yyyyMMdd").alias("compact"), F.unix_micros(F.col("retrieved_at").cast("timestamp")).alias("retrieved_us"), F.try_to_date("lang").isNull().alias("lang_is_no_date"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, (length(text) + 1023) // 1024 AS pieces, CASE WHEN text = '' THEN 0 ELSE (length(text) - 1) % 1024 + 1 END AS last_length FROM chunks")
def fixed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).select("chunk_id", tx.fixed_pieces(F.col("text")).alias("p"))
    return c.select("chunk_id", F.size("p").cast("long").alias("pieces"), F.coalesce(F.char_length(F.element_at("p", -1)), F.lit(0)).cast("long").alias("last_length"))


@register(r"""WITH n AS (SELECT DISTINCT assertion_id, list_transform(regexp_extract_all(translate(raw_text, '−,', '-.'), '-?\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS n FROM annotations WHERE raw_text IS NOT NULL) SELECT assertion_id, len(n) AS numbers, round(n[1], 6) AS first FROM n""")
def numeric_extraction(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "annotations").where("raw_text is not null").select("assertion_id", tx.numbers_in(F.col("raw_text")).alias("n")).distinct()
    return a.select("assertion_id", F.size("n").cast("long").alias("numbers"), F.round(F.get("n", F.lit(0)), 6).alias("first"))


@register("SELECT DISTINCT canonical_name, lower(regexp_replace(regexp_replace(canonical_name, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug, left(regexp_replace(canonical_name, '\\p{C}', '', 'g'), 24) AS label FROM concept_mentions WHERE canonical_name IS NOT NULL")
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "concept_mentions").where("canonical_name is not null").select("canonical_name").distinct()
    slug = F.lower(F.regexp_replace(F.regexp_replace("canonical_name", "[^A-Za-z0-9]+", "-"), "^-|-$", ""))
    return n.select("canonical_name", slug.alias("slug"), tx.printable(F.col("canonical_name"), 24).alias("label"))


@register("SELECT revision_id, coalesce(extraction_splits, 0)::BIGINT AS splits, least(2.0 * pow(2, coalesce(extraction_splits, 0)), 60.0) AS wait_seconds, round(CASE WHEN isfinite(extraction_seconds) THEN extraction_seconds ELSE 0 END, 6) AS seconds FROM graph_index_results")
def backoff(spark: SparkSession, folder: str) -> DataFrame:
    splits = F.coalesce("extraction_splits", F.lit(0))
    return table(spark, folder, "graph_index_results").select("revision_id", splits.cast("long").alias("splits"), tx.backoff_seconds(splits + 1, 2.0, 60.0).alias("wait_seconds"), F.round(rules.finite_or_zero(F.col("extraction_seconds")), 6).alias("seconds"))


@register("SELECT doc_id, regexp_replace('{\"doc\": ' || doc_id || ', \"api_key\": \"[masked]\", \"note\": \"Bearer [masked] end\"}', ' +', ' ', 'g') AS masked FROM documents")
def redact_secrets(spark: SparkSession, folder: str) -> DataFrame:
    log = F.concat(F.lit('{"doc": '), F.col("doc_id").cast("string"), F.lit(', "api_key": "k-'), "document_id", F.lit('", "note": "Bearer '), "document_id", F.lit(' end"}'))
    return table(spark, folder, "documents").select("doc_id", rules.masked(log).alias("masked"))


@register(r"WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL) SELECT doc_id, words, CASE WHEN words BETWEEN 1 AND 20000 THEN true END AS same FROM w")
def inverted_index_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts taken apart into word positions and put together again; true where the words come back, null for texts without
    words or of more than 20,000, which have no valid index."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", words.alias("w"))
    d = d.select("doc_id", "w", tx.positions_of_words("w").alias("index"))
    same = F.when(F.size("w").between(1, 20_000), tx.words_by_position(F.col("index")) == F.array_join("w", " "))
    return d.select("doc_id", F.size("w").alias("words"), same.alias("same"))


@register()
def chunk_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in chunks of at most 1,200 code points that keep sentences together."""
    s = _document_chunks(spark, folder)
    return s.select("doc_id", "ordinal", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "language", F.sha2(_part(), 256).alias("hash"))


def _part() -> Column:
    return F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))


def _document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", tx.language_or_guess(F.col("lang"), F.col("text")).alias("language"))
    return d.select("doc_id", "text", "language", F.posexplode(tx.chunks_of("text", "language")).alias("ordinal", "s"))


@register(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS letters, true AS bounded, true AS trimmed, length(trim(text)) > 1200 AS split FROM documents WHERE regexp_matches(text, '\S')")
def chunk_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What the chunks of a document hold together, and whether each is within the limit and trimmed."""
    letters = F.char_length(F.regexp_replace(_part(), r"[^\p{L}\p{N}]", ""))
    c = _document_chunks(spark, folder).select("doc_id", letters.alias("n"), (F.char_length(_part()) <= 1200).alias("bounded"), (F.trim(_part()) == _part()).alias("trimmed"))
    return c.groupBy("doc_id").agg(F.sum("n").alias("letters"), F.every("bounded").alias("bounded"), F.every("trimmed").alias("trimmed"), (F.count("*") > 1).alias("split"))


@register(f"WITH {_CANDIDATES} SELECT candidate_id, strpos(quote, target_text) - 1 AS offset_in_quote, CASE WHEN strpos(quote, target_text) > 0 THEN span_start + strpos(quote, target_text) - 1 ELSE -1 END AS target_start FROM candidates WHERE target_text <> ''")
def quote_offsets(spark: SparkSession, folder: str) -> DataFrame:
    at = F.expr("instr(quote, target_text)")
    return candidates(spark, folder).where("target_text <> ''").select("candidate_id", (at - 1).cast("long").alias("offset_in_quote"), F.when(at > 0, F.col("span_start") + at - 1).otherwise(-1).cast("long").alias("target_start"))


_PARTS = "CASE WHEN length(text) > 800 THEN 8 WHEN length(text) > 400 THEN 4 WHEN length(text) > 200 THEN 2 ELSE 1 END"


@register(f"WITH {_CHUNKS} SELECT chunk_id, {_PARTS} AS parts, greatest(1, ceil(length(text) / {_PARTS})) > 200 AS refused, md5(text) AS joined FROM chunks WHERE text IS NOT NULL")
def adaptive_halving(spark: SparkSession, folder: str) -> DataFrame:
    """Texts halved up to three times for a model that takes 200 code points; those still too long are refused."""
    c = chunks(spark, folder).where("text is not null").select("chunk_id", tx.halved(F.col("text"), 200).alias("p"))
    longest = F.array_max(F.transform("p", F.char_length))
    return c.select("chunk_id", F.size("p").alias("parts"), (longest > 200).alias("refused"), F.md5(F.array_join("p", "")).alias("joined"))


_ASCII = "regexp_full_match(canonical_name, '[\\x20-\\x7E]*')"


@register(
    f"""SELECT DISTINCT canonical_name, CASE WHEN {_ASCII} THEN trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) END AS folded, CASE WHEN {_ASCII} THEN trim(regexp_replace(canonical_name, '\\s+', ' ', 'g')) END AS composed,
    CASE WHEN {_ASCII} THEN trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', ' ', 'g')) END AS concept FROM concept_mentions WHERE canonical_name IS NOT NULL"""
)
def normal_forms_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The forms of names of plain characters, as SQL can give them; null for other names."""
    plain = F.col("canonical_name").rlike(r"^[\x20-\x7E]*$")
    forms = normal_forms(spark, folder)
    return forms.select("canonical_name", *[F.when(plain, F.col(c)).alias(c) for c in ("folded", "composed", "concept")])


QUERIES, ORACLE = register.queries, register.sql
