"""Retrieval: lexical scores, vector neighbours, fusion, excerpts and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.io import table
from skein.operators import lexical, packs, ranking, vectors
from skein.operators.latest import newest
from skein.plans.registry import Register

register = Register()
QUERY = "response of the ZnO sensor to acetone"
_TERMS = r"list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}\p{M}]+'), lambda t: length(t) > 1)"
_Q = ["response", "of", "the", "zno", "sensor", "to", "acetone"]


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence, each id once: the latest delivery."""
    return newest(table(spark, folder, "candidate_evidence").where("evidence_id is not null"), ["evidence_id"], F.col("received_at"))


_EVIDENCE = "evidence AS (SELECT DISTINCT ON (evidence_id) * FROM candidate_evidence ORDER BY evidence_id, received_at DESC)"


@register(
    f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
    n AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM t),
    q AS (SELECT unnest({_Q}) AS term),
    f AS (SELECT doc_id, q.term, len(list_filter(terms, lambda x: x = q.term)) AS f, len(terms) AS l FROM t, q),
    d AS (SELECT term, count(*) FILTER (f > 0) AS df FROM f GROUP BY term),
    s AS (SELECT doc_id, sum(CASE WHEN f > 0 THEN ln(1 + (n.n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al)) ELSE 0 END) AS score FROM f JOIN d USING (term), n GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 50"""
)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """By built-in expressions alone; see bm25_compatible for texts in compatibility characters."""
    scored = lexical.bm25(table(spark, folder, "documents").select("doc_id", "text"), tx.plain_terms(F.col("text")), QUERY)
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@register()
def bm25_compatible(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores over terms in compatibility form."""
    scored = lexical.bm25(table(spark, folder, "documents").select("doc_id", "text"), tx.terms("text"), QUERY)
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@register(
    f"""WITH {_EVIDENCE},
    c AS (SELECT evidence_id, source || ':' || external_id AS key, chunk_id, section, source, external_id, score, unnest(list_distinct(channels)) AS channel FROM evidence WHERE source IN ('epo_ops', 'openalex') AND score IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, source, external_id, chunk_id NULLS FIRST, evidence_id) AS rank FROM c),
    f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY channel, key ORDER BY rank) = 1),
    k AS (SELECT key, coalesce(chunk_id, '') AS chunk_id, sum(1.0 / (60 + rank)) AS part, min(section) AS section, list(DISTINCT channel) AS ch FROM f GROUP BY ALL),
    b AS (SELECT key, chunk_id, section FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(part, 12) DESC, section, chunk_id) = 1),
    s AS (SELECT key, sum(part) AS score, list_sort(list_distinct(flatten(list(ch)))) AS ch FROM k GROUP BY key)
    SELECT s.key, round(s.score, 9) AS score, b.chunk_id, b.section, array_to_string(s.ch, ',') AS channels FROM s JOIN b USING (key)"""
)
def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of public sources, one ranked list per channel, fused over the source record."""
    public = evidence(spark, folder).where(F.col("source").isin("epo_ops", "openalex") & F.col("score").isNotNull())
    lists = public.select("evidence_id", F.concat_ws(":", "source", "external_id").alias("key"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "section", "source", "external_id", "score", F.explode(F.array_distinct("channels")).alias("channel"))
    lists = lists.withColumn("channels", F.array("channel"))
    order = [F.col("score").desc(), F.col("source"), F.col("external_id"), F.col("chunk_id"), F.col("evidence_id")]
    fused = ranking.reciprocal_rank_fusion(lists, "channel", "key", "chunk_id", "section", order, "channels")
    return fused.select("key", F.round("score", 9).alias("score"), "chunk_id", "section", F.array_join("channels", ",").alias("channels"))


@register(
    f"""WITH {_EVIDENCE} SELECT source, section, lower(split_part(language, '-', 1)) AS language, count(*) AS n, round(avg(score), 6) AS mean_score
    FROM evidence WHERE source IN ('epo_ops', 'openalex') AND section IN ('abstract', 'claims') AND len(channels) > 0 GROUP BY ALL"""
)
def payload_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = evidence(spark, folder).where(F.col("source").isin("epo_ops", "openalex") & F.col("section").isin("abstract", "claims") & (F.size("channels") > 0))
    return kept.groupBy("source", "section", F.lower(F.substring_index("language", "-", 1)).alias("language")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@register(f"WITH {_EVIDENCE} SELECT chunk_id, round(max(score), 6) AS score FROM evidence WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def max_score_per_chunk(spark: SparkSession, folder: str) -> DataFrame:
    return evidence(spark, folder).where("chunk_id is not null").groupBy("chunk_id").agg(F.round(F.max("score"), 6).alias("score"))


@register(f"WITH {_EVIDENCE} SELECT evidence_id, round(score, 6) AS score, source, external_id FROM evidence WHERE score IS NOT NULL ORDER BY round(score, 6) DESC, source, external_id, evidence_id LIMIT 100")
def top_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence(spark, folder).where("score is not null").select("evidence_id", F.round("score", 6).alias("score"), "source", "external_id")
    return rows.orderBy(F.desc("score"), "source", "external_id", "evidence_id").limit(100)


@register(
    f"""WITH {_EVIDENCE}, c AS (SELECT source, unnest(channels) AS channel, section FROM evidence)
    SELECT channel, source, count(*) AS rows, count(DISTINCT section) AS sections, bool_or(section = 'abstract') AS has_abstract FROM c GROUP BY ALL"""
)
def channel_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence(spark, folder).select("source", F.explode("channels").alias("channel"), "section")
    return rows.groupBy("channel", "source").agg(F.count("*").alias("rows"), F.count_distinct("section").alias("sections"), F.bool_or(F.col("section") == "abstract").alias("has_abstract"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


@register(
    f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), s AS (
      SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_dot_product(q.v, b.v), 9) AS similarity FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, neighbour_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS rank FROM s QUALIFY rank <= 10"""
)
def knn_top(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    found = vectors.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@register(
    f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), s AS (
      SELECT q.vec_id AS q, b.vec_id AS n, round(list_dot_product(q.v, b.v), 9) AS s FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS r FROM s QUALIFY r <= 8)
    SELECT least(q, n) AS feature_a, greatest(q, n) AS feature_b, round(max(s), 6) AS similarity FROM t WHERE s >= 0.2 GROUP BY ALL"""
)
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of each query with its nearest rows above the floor, either order once, with the larger similarity."""
    e = table(spark, folder, "embeddings")
    found = vectors.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 8, 0.2)
    return found.groupBy(F.least("query_id", "neighbour_id").alias("feature_a"), F.greatest("query_id", "neighbour_id").alias("feature_b")).agg(F.round(F.max("similarity"), 6).alias("similarity"))


@register(
    f"""WITH u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings)
    SELECT least(greatest(floor((round(list_dot_product(q.v, b.v), 9) + 1) * 10), 0), 19)::BIGINT AS bin, count(*) AS pairs FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL"""
)
def similarity_bins(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return vectors.similarity_histogram(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 20)


@register(
    f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), s AS (
      SELECT q.label AS ql, b.label AS bl, q.vec_id AS q, b.vec_id AS n, round(list_dot_product(q.v, b.v), 9) AS s FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS r FROM s QUALIFY r <= 3)
    SELECT ql AS label, count(*) AS neighbours, count(*) FILTER (ql = bl) AS same_label, count(*) FILTER (r = 1 AND ql = bl) AS same_top1, round(avg(s), 6) AS mean_similarity FROM t GROUP BY ql"""
)
def within_between(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    found = vectors.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 3)
    labels = e.select("vec_id", "label")
    both = found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label")), "query_id").join(labels.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("other")), "neighbour_id")
    same = F.col("label") == F.col("other")
    return both.groupBy("label").agg(F.count("*").alias("neighbours"), F.count_if(same).alias("same_label"), F.count_if(same & (F.col("rank") == 1)).alias("same_top1"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def _pool_sql(weight: str) -> str:
    return f"""WITH u AS (SELECT label, {weight} AS w, {_UNIT} AS v FROM embeddings),
    x AS (SELECT label, w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS position FROM u),
    m AS (SELECT label, position, sum(x * w) / sum(w) AS m FROM x GROUP BY ALL)
    SELECT label, position, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) + 0.0 AS value FROM m"""


@register(_pool_sql("1.0"))
def pooled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    p = vectors.pooled(table(spark, folder, "embeddings"), "label", "embedding")
    return p.select("label", F.col("position").cast("long").alias("position"), (F.round("value", 6) + 0.0).alias("value"))


@register(_pool_sql("(1 + vec_id % 5)"))
def weighted_pooled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    p = vectors.pooled(table(spark, folder, "embeddings"), "label", "embedding", 1 + F.col("vec_id") % 5)
    return p.select("label", F.col("position").cast("long").alias("position"), (F.round("value", 6) + 0.0).alias("value"))


@register(
    f"""WITH u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), s AS (SELECT a.label, a.vec_id, round(avg(list_dot_product(a.v, b.v)), 9) AS s FROM u a JOIN u b ON a.label = b.label GROUP BY ALL)
    SELECT label, vec_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1"""
)
def medoid_label(spark: SparkSession, folder: str) -> DataFrame:
    m = vectors.medoids(table(spark, folder, "embeddings"), "label", "vec_id", "embedding")
    return m.select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


@register()
def snippet_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The three sentences of each piece of evidence that share most with the query."""
    spans = evidence(spark, folder).select("evidence_id", "text", F.explode(tx.snippet_spans("text")).alias("s"))
    quote = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    wanted = F.array(*[F.lit(t) for t in sorted(set(tx.term_list(QUERY)))])
    quotes = spans.select("evidence_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), quote.alias("quote"))
    scored = quotes.withColumn("score", F.round(lexical.overlap_score(wanted, tx.terms("quote")), 9)).where("score > 0")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "start", "end", "quote", "score"))), 1, 3)
    return scored.groupBy("evidence_id").agg(best.alias("b")).select("evidence_id", F.explode("b").alias("x")).select("evidence_id", "x.start", "x.end", "x.quote", F.round("x.score", 6).alias("score"))


@register()
def evidence_packs(spark: SparkSession, folder: str) -> DataFrame:
    """For every document the excerpts of its evidence that fit a budget of 120 words."""
    best = snippet_top3(spark, folder).groupBy("evidence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "start", "end", "quote"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["quote"].alias("quote"))).alias("excerpts"))
    ranked = evidence(spark, folder).where("document_id is not null").select("evidence_id", F.col("document_id").alias("query"), F.col("evidence_id").alias("document_id"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), (-F.coalesce("score", F.lit(0.0))).alias("rank"))
    return packs.packs(ranked.join(best, "evidence_id").drop("evidence_id"), "query", "rank", lambda t: len(t.split()), 120, 12)


QUERIES, ORACLE = register.queries, register.sql
