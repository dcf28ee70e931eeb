"""Aggregations: counts, quantiles, histograms, evaluation measures and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.io import table
from skein.operators import measures
from skein.plans.registry import Register
from skein.plans.relational import _ASSERTIONS, _CANDIDATES, _CHUNKS, _EVIDENCE, _MENTIONS, assertions, candidates, chunks, evidence, mentions

register = Register()


@register("SELECT event_type, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def count_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@register("SELECT count(*) AS rows, count(extraction_seconds) AS timed, coalesce(sum(fact_count), 0)::BIGINT AS facts, coalesce(sum(extraction_splits), 0)::BIGINT AS splits FROM graph_index_results")
def global_sums(spark: SparkSession, folder: str) -> DataFrame:
    zero = F.lit(0)
    return table(spark, folder, "graph_index_results").agg(F.count("*").alias("rows"), F.count("extraction_seconds").alias("timed"), F.coalesce(F.sum("fact_count"), zero).alias("facts"), F.coalesce(F.sum("extraction_splits"), zero).alias("splits"))


@register("SELECT least(feature_a, feature_b) AS feature_a, greatest(feature_a, feature_b) AS feature_b, round(max(candidate_similarity), 6) AS similarity FROM pair_decisions WHERE feature_b IS NOT NULL AND feature_a <> feature_b GROUP BY ALL")
def pair_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pair_decisions").where("feature_b is not null and feature_a <> feature_b")
    return p.groupBy(F.least("feature_a", "feature_b").alias("feature_a"), F.greatest("feature_a", "feature_b").alias("feature_b")).agg(F.round(F.max("candidate_similarity"), 6).alias("similarity"))


@register("SELECT upper(trim(decision)) AS decision, count(*) AS n, count(*) FILTER (same_probability >= 0.9 AND confidence >= 0.9) AS gated, round(avg(candidate_similarity), 6) AS similarity FROM pair_decisions GROUP BY ALL")
def same_gate(spark: SparkSession, folder: str) -> DataFrame:
    gate = (F.col("same_probability") >= 0.9) & (F.col("confidence") >= 0.9)
    return table(spark, folder, "pair_decisions").groupBy(F.upper(F.trim("decision")).alias("decision")).agg(F.count("*").alias("n"), F.count_if(gate).alias("gated"), F.round(F.avg("candidate_similarity"), 6).alias("similarity"))


@register(f"WITH {_CHUNKS}, {_CANDIDATES} SELECT c.document_id, g.target_text, count(*) AS evidence_count FROM candidates g JOIN chunks c ON g.evidence_chunk_id = c.chunk_id GROUP BY ALL")
def evidence_count(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).select(F.col("chunk_id").alias("evidence_chunk_id"), "document_id")
    return candidates(spark, folder).select("evidence_chunk_id", "target_text").join(c, "evidence_chunk_id").groupBy("document_id", "target_text").agg(F.count("*").alias("evidence_count"))


@register(
    f"""WITH {_MENTIONS}, {_CHUNKS} SELECT m.canonical_name, count(DISTINCT m.surface_text) AS aliases, count(DISTINCT c.document_id) AS documents, arg_min(m.surface_text, struct_pack(l := length(m.quote), s := m.surface_text)) AS shortest_context_alias, min(m.mention_id) AS first_mention
    FROM mentions m JOIN chunks c USING (chunk_id) GROUP BY m.canonical_name"""
)
def feature_groups(spark: SparkSession, folder: str) -> DataFrame:
    m = mentions(spark, folder).select("mention_id", "chunk_id", "canonical_name", "surface_text", "quote").join(chunks(spark, folder).select("chunk_id", "document_id"), "chunk_id")
    return m.groupBy("canonical_name").agg(F.count_distinct("surface_text").alias("aliases"), F.count_distinct("document_id").alias("documents"), F.min_by("surface_text", F.struct(F.char_length("quote"), F.col("surface_text"))).alias("shortest_context_alias"), F.min("mention_id").alias("first_mention"))


@register("WITH c AS (SELECT DISTINCT cluster_id, raw_aliases FROM feature_clusters), a AS (SELECT cluster_id, unnest(list_distinct(raw_aliases)) AS alias FROM c) SELECT alias, count(*) AS clusters FROM a GROUP BY alias")
def alias_frequency(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "feature_clusters").select("cluster_id", F.explode("raw_aliases").alias("alias")).distinct()
    return c.groupBy("alias").agg(F.count("*").alias("clusters"))


_P = "round(quantile_cont(extraction_seconds, {p}), 6)"


@register(f"SELECT indexer_version, {_P.format(p=0.25)} AS p25, {_P.format(p=0.5)} AS p50, {_P.format(p=0.75)} AS p75, {_P.format(p=0.95)} AS p95 FROM graph_index_results WHERE extraction_seconds IS NOT NULL GROUP BY indexer_version")
def quantiles_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolated quantiles at place (n - 1) * p."""
    q = [F.round(F.percentile("extraction_seconds", F.lit(p / 100)), 6).alias(f"p{p}") for p in (25, 50, 75, 95)]
    return table(spark, folder, "graph_index_results").where("extraction_seconds is not null").groupBy("indexer_version").agg(*q)


@register("SELECT event_type, round(quantile_disc(value, 0.95), 6) AS p95, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def nearest_p95(spark: SparkSession, folder: str) -> DataFrame:
    """The value at place ceil(0.95 n)."""
    return table(spark, folder, "events").where("value is not null").groupBy("event_type").agg(F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"), F.count("*").alias("n"))


@register("WITH l AS (SELECT indexer_version, list_sort(list(extraction_seconds)) AS v FROM graph_index_results WHERE extraction_seconds IS NOT NULL GROUP BY 1) SELECT indexer_version, round(v[floor((len(v) - 1) * 0.95)::BIGINT + 1], 6) AS p95_truncated, round(v[greatest(0, floor(len(v) * 0.95)::BIGINT - 1) + 1], 6) AS p95_floor FROM l")
def quantiles_by_place(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "graph_index_results").where("extraction_seconds is not null")
    return r.groupBy("indexer_version").agg(F.round(measures.truncated_quantile(F.col("extraction_seconds"), 0.95), 6).alias("p95_truncated"), F.round(measures.floor_quantile(F.col("extraction_seconds"), 0.95), 6).alias("p95_floor"))


@register("SELECT d.source, r.indexer_version, round(median(extraction_seconds), 6) AS median_seconds, count(*) AS n FROM graph_index_results r JOIN documents d USING (document_id) GROUP BY ALL")
def median_group(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "graph_index_results").select("document_id", "indexer_version", "extraction_seconds")
    joined = r.join(table(spark, folder, "documents").select("document_id", "source"), "document_id")
    return joined.groupBy("source", "indexer_version").agg(F.round(F.median("extraction_seconds"), 6).alias("median_seconds"), F.count("*").alias("n"))


@register("SELECT least(floor(value / 10), 20)::BIGINT AS bin, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high FROM events WHERE value IS NOT NULL GROUP BY ALL")
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("value is not null")
    return e.groupBy(F.least(F.floor(F.col("value") / 10), F.lit(20)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


@register("SELECT indexer_version, round(avg(extraction_seconds), 6) AS mean_seconds, round(sum(extraction_seconds) / nullif(sum(fact_count) FILTER (extraction_seconds IS NOT NULL), 0), 6) AS seconds_per_fact FROM graph_index_results GROUP BY 1")
def ratio_of_sums(spark: SparkSession, folder: str) -> DataFrame:
    facts = F.sum(F.when(F.col("extraction_seconds").isNotNull(), F.col("fact_count")))
    return table(spark, folder, "graph_index_results").groupBy("indexer_version").agg(F.round(F.avg("extraction_seconds"), 6).alias("mean_seconds"), F.round(measures.ratio(F.sum("extraction_seconds"), facts, None), 6).alias("seconds_per_fact"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Gold from the decision, prediction from the probability."""
    predicted = F.when(F.col("same_probability") >= 0.75, "SAME").when(F.col("same_probability") < 0.5, "DIFFERENT").otherwise("UNCERTAIN")
    return table(spark, folder, "pair_decisions").select(F.upper(F.trim("decision")).alias("gold"), predicted.alias("predicted"), "same_probability")


_LABELLED = "x AS (SELECT upper(trim(decision)) AS gold, CASE WHEN same_probability >= 0.75 THEN 'SAME' WHEN same_probability < 0.5 THEN 'DIFFERENT' ELSE 'UNCERTAIN' END AS predicted, same_probability FROM pair_decisions)"


@register(f"WITH {_LABELLED} SELECT gold, predicted, count(*) AS n FROM x GROUP BY ALL")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return measures.confusion(_labelled(spark, folder), "gold", "predicted")


@register(
    f"""WITH {_LABELLED}, g AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (gold = predicted) AS hits FROM x GROUP BY 1), s AS (SELECT predicted AS label, count(*) AS said FROM x GROUP BY 1),
    b AS (SELECT coalesce(g.label, s.label) AS label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(said, 0) AS said FROM g FULL JOIN s ON g.label = s.label),
    p AS (SELECT label, support, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM b)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support::BIGINT AS support FROM p"""
)
def confusion_prf(spark: SparkSession, folder: str) -> DataFrame:
    per = measures.per_class(measures.confusion(_labelled(spark, folder), "gold", "predicted"), "gold", "predicted")
    return per.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@register(
    f"""WITH {_LABELLED}, t AS (SELECT unnest([0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (same_probability >= threshold AND gold = 'SAME') AS tp, count(*) FILTER (same_probability >= threshold AND gold <> 'SAME') AS fp,
      count(*) FILTER (gold = 'SAME') AS pos, count(*) FILTER (gold <> 'SAME') AS neg FROM x, t GROUP BY threshold), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS r FROM c)
    SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, tp + fp AS accepted, round(CASE WHEN neg > 0 THEN fp / neg ELSE 0 END, 6) AS false_accept_rate FROM p"""
)
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    s = measures.threshold_sweep(_labelled(spark, folder), F.col("gold") == "SAME", F.col("same_probability"), [0.7, 0.75, 0.8, 0.85, 0.9, 0.95])
    return s.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "accepted", F.round("false_accept_rate", 6).alias("false_accept_rate"))


@register(f"WITH {_LABELLED} SELECT count(*) AS n, round(avg((gold = predicted)::INT), 6) AS accuracy, bool_and(same_probability BETWEEN 0 AND 1) AS probabilities_valid, bool_or(gold = 'SAME' AND predicted = 'DIFFERENT') AS any_missed FROM x")
def label_gates(spark: SparkSession, folder: str) -> DataFrame:
    x = _labelled(spark, folder)
    return x.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("int")), 6).alias("accuracy"), F.bool_and(F.col("same_probability").between(0, 1)).alias("probabilities_valid"), F.bool_or((F.col("gold") == "SAME") & (F.col("predicted") == "DIFFERENT")).alias("any_missed"))


@register(
    f"""WITH {_EVIDENCE}, r AS (SELECT document_id, list_contains(channels, 'graph') AS rel, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(score, 0) DESC, evidence_id) AS rank FROM evidence),
    m AS (SELECT document_id, count(*) FILTER (rel) AS wanted, count(*) FILTER (rel AND rank <= 3) AS found, min(rank) FILTER (rel) AS first FROM r GROUP BY 1)
    SELECT document_id, round(CASE WHEN wanted > 0 THEN found / wanted END, 6) AS recall_at_k, round(1.0 / first, 6) AS reciprocal_rank, found > 0 AS top_k_hit FROM m"""
)
def recall_at_3(spark: SparkSession, folder: str) -> DataFrame:
    """Recall at 3 and reciprocal rank of graph evidence in each document's list; null where there is none. A document's list is bounded."""
    w = Window.partitionBy("document_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "evidence_id")
    r = evidence(spark, folder).select("document_id", "channels", F.row_number().over(w).alias("rank"))
    m = measures.ranking_measures(r, "document_id", "rank", F.array_contains("channels", "graph"), 3)
    return m.select("document_id", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "top_k_hit")


@register(f"WITH {_CANDIDATES}, {_CHUNKS} SELECT edge_type, count(*) AS citations, count(*) FILTER (substr(c.text, g.span_start + 1, g.span_end - g.span_start) = g.quote) AS exact, round(avg((substr(c.text, g.span_start + 1, g.span_end - g.span_start) = g.quote)::INT), 6) AS validity FROM candidates g JOIN chunks c ON g.evidence_chunk_id = c.chunk_id GROUP BY 1")
def citation_validity(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).select(F.col("chunk_id").alias("evidence_chunk_id"), "text")
    g = candidates(spark, folder).select("edge_type", "evidence_chunk_id", "span_start", "span_end", "quote").join(c, "evidence_chunk_id")
    exact = F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("quote")
    return g.groupBy("edge_type").agg(F.count("*").alias("citations"), F.count_if(exact).alias("exact"), F.round(F.avg(exact.cast("int")), 6).alias("validity"))


@register(f"WITH {_ASSERTIONS} SELECT coalesce(campaign_code, 'ALL') AS scope, support_status, count(*) AS n FROM assertions GROUP BY GROUPING SETS ((support_status), (campaign_code, support_status))")
def grouping_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each status over all campaigns and for each campaign."""
    a = assertions(spark, folder).select("campaign_code", "support_status")
    both = a.groupingSets([["support_status"], ["campaign_code", "support_status"]], "campaign_code", "support_status").agg(F.count("*").alias("n"))
    return both.select(F.coalesce("campaign_code", F.lit("ALL")).alias("scope"), "support_status", "n")


@register("SELECT coalesce(split, 'TOTAL') AS split, count(*) AS items, sum(length(text))::BIGINT AS characters FROM eval_items GROUP BY ROLLUP (split)")
def split_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").rollup("split").agg(F.count("*").alias("items"), F.sum(F.char_length("text")).alias("characters")).select(F.coalesce("split", F.lit("TOTAL")).alias("split"), "items", "characters")


@register(f"WITH {_ASSERTIONS} SELECT count(*) AS triples, count(*) - count(DISTINCT (head_mention_id, relation_type, tail_mention_id)) AS repeated, count(*) FILTER (qualifier_type IS NOT NULL) AS qualified FROM assertions WHERE head_mention_id IS NOT NULL AND relation_type IS NOT NULL AND tail_mention_id IS NOT NULL")
def duplicate_triples(spark: SparkSession, folder: str) -> DataFrame:
    a = assertions(spark, folder).where("head_mention_id is not null and relation_type is not null and tail_mention_id is not null")
    return a.agg(F.count("*").alias("triples"), (F.count("*") - F.count_distinct("head_mention_id", "relation_type", "tail_mention_id")).alias("repeated"), F.count_if(F.col("qualifier_type").isNotNull()).alias("qualified"))


@register(f"WITH {_ASSERTIONS}, n AS (SELECT campaign_code, relation_type, count(*) AS n FROM assertions WHERE relation_type IS NOT NULL GROUP BY ALL) SELECT campaign_code, arg_min(relation_type, struct_pack(n := -n, r := relation_type)) AS most_common, max(n) AS times, sum(n)::BIGINT AS assertions, max(n) > 0.5 * sum(n) AS priority FROM n GROUP BY 1")
def campaign_summary(spark: SparkSession, folder: str) -> DataFrame:
    n = assertions(spark, folder).where("relation_type is not null").groupBy("campaign_code", "relation_type").agg(F.count("*").alias("n"))
    return n.groupBy("campaign_code").agg(F.min_by("relation_type", F.struct(-F.col("n"), F.col("relation_type"))).alias("most_common"), F.max("n").alias("times"), F.sum("n").alias("assertions"), (F.max("n") > 0.5 * F.sum("n")).alias("priority"))


@register("SELECT campaign_code, count(*) AS deliveries, count(DISTINCT assertion_id) AS distinct_rows, count(*) - count(DISTINCT assertion_id) AS repeats, CASE WHEN count(*) = count(DISTINCT assertion_id) THEN 'CLEAN' ELSE 'REPEATED' END AS outcome FROM annotations GROUP BY 1")
def delivery_accounting(spark: SparkSession, folder: str) -> DataFrame:
    n, d = F.count("*"), F.count_distinct("assertion_id")
    return table(spark, folder, "annotations").groupBy("campaign_code").agg(n.alias("deliveries"), d.alias("distinct_rows"), (n - d).alias("repeats"), F.when(n == d, "CLEAN").otherwise("REPEATED").alias("outcome"))


@register(f"WITH {_CANDIDATES}, x AS (SELECT evidence_chunk_id, count(*) AS raw, count(*) FILTER (target_label IS NOT NULL) AS accepted, count(*) FILTER (target_label IS NULL) AS rejected, bool_or(confidence IS NULL) AS unknown FROM candidates GROUP BY 1) SELECT count(*) AS chunks, sum(raw)::BIGINT AS raw, sum(accepted)::BIGINT AS accepted, sum(rejected)::BIGINT AS rejected, count(*) FILTER (raw <> accepted + rejected) AS broken, count(*) FILTER (unknown) AS unknown FROM x")
def conservation(spark: SparkSession, folder: str) -> DataFrame:
    known = F.col("target_label").isNotNull()
    x = candidates(spark, folder).groupBy("evidence_chunk_id").agg(F.count("*").alias("raw"), F.count_if(known).alias("accepted"), F.count_if(~known).alias("rejected"), F.bool_or(F.col("confidence").isNull()).alias("unknown"))
    return x.agg(F.count("*").alias("chunks"), F.sum("raw").alias("raw"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count_if(F.col("raw") != F.col("accepted") + F.col("rejected")).alias("broken"), F.count_if("unknown").alias("unknown"))


@register(
    f"""WITH {_CHUNKS}, {_CANDIDATES}, {_MENTIONS}, d AS (SELECT DISTINCT document_id FROM chunks), f AS (SELECT DISTINCT c.document_id FROM candidates g JOIN chunks c ON g.evidence_chunk_id = c.chunk_id), m AS (SELECT DISTINCT c.document_id FROM mentions m JOIN chunks c USING (chunk_id)),
    p AS (SELECT d.document_id IN (SELECT document_id FROM f) AS has_facts, d.document_id IN (SELECT document_id FROM m) AS has_mentions FROM d), g AS (SELECT a.v AS has_facts, b.v AS has_mentions FROM (VALUES (true), (false)) a(v), (VALUES (true), (false)) b(v))
    SELECT g.has_facts, g.has_mentions, count(p.has_facts) AS documents FROM g LEFT JOIN p ON g.has_facts = p.has_facts AND g.has_mentions = p.has_mentions GROUP BY ALL"""
)
def contingency_2x2(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with and without facts and mentions; empty cells stay."""
    c = chunks(spark, folder).select("chunk_id", "document_id")
    f = candidates(spark, folder).select(F.col("evidence_chunk_id").alias("chunk_id")).join(c, "chunk_id").select("document_id").distinct().withColumn("f", F.lit(True))
    m = mentions(spark, folder).select("chunk_id").join(c, "chunk_id").select("document_id").distinct().withColumn("m", F.lit(True))
    flags = c.select("document_id").distinct().join(f, "document_id", "left").join(m, "document_id", "left").select(F.coalesce("f", F.lit(False)).alias("has_facts"), F.coalesce("m", F.lit(False)).alias("has_mentions"))
    counts = flags.groupBy("has_facts", "has_mentions").agg(F.count("*").alias("documents"))
    grid = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "has_facts boolean, has_mentions boolean")
    return grid.join(counts, ["has_facts", "has_mentions"], "left").select("has_facts", "has_mentions", F.coalesce("documents", F.lit(0)).alias("documents"))


@register(
    """WITH m AS (SELECT indexer_version, avg(extraction_seconds) AS seconds, avg(fact_count) AS facts, avg(coalesce(extraction_splits, 0)) AS splits FROM graph_index_results GROUP BY 1), u AS (UNPIVOT m ON seconds, facts, splits INTO NAME measure VALUE v)
    SELECT measure, round(max(v) FILTER (indexer_version = 'graph-index-v1'), 6) AS before, round(max(v) FILTER (indexer_version = 'graph-index-v2'), 6) AS after, round(max(v) FILTER (indexer_version = 'graph-index-v2') - max(v) FILTER (indexer_version = 'graph-index-v1'), 6) AS delta FROM u GROUP BY measure"""
)
def before_after(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "graph_index_results").groupBy("indexer_version").agg(F.avg("extraction_seconds").alias("seconds"), F.avg("fact_count").alias("facts"), F.avg(F.coalesce("extraction_splits", F.lit(0))).alias("splits"))
    u = m.unpivot("indexer_version", ["seconds", "facts", "splits"], "measure", "v")
    v = lambda n: F.max(F.when(F.col("indexer_version") == f"graph-index-v{n}", F.col("v")))
    return u.groupBy("measure").agg(F.round(v(1), 6).alias("before"), F.round(v(2), 6).alias("after"), F.round(v(2) - v(1), 6).alias("delta"))


@register(
    """WITH m AS (SELECT d.source, r.indexer_version, avg(r.fact_count) AS f FROM graph_index_results r JOIN documents d USING (document_id) GROUP BY ALL), p AS (SELECT source, max(f) FILTER (indexer_version = 'graph-index-v1') AS a, max(f) FILTER (indexer_version = 'graph-index-v2') AS b FROM m GROUP BY 1)
    SELECT source, round(a, 6) AS baseline, round(b, 6) AS current, coalesce(b < a - 0.05 - 1e-12, false) AS regressed FROM p"""
)
def baseline_regressions(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "graph_index_results").join(table(spark, folder, "documents").select("document_id", "source"), "document_id")
    v = lambda n: F.avg(F.when(F.col("indexer_version") == f"graph-index-v{n}", F.col("fact_count")))
    p = r.groupBy("source").agg(v(1).alias("a"), v(2).alias("b"))
    return p.select("source", F.round("a", 6).alias("baseline"), F.round("b", 6).alias("current"), F.coalesce(F.col("b") < F.col("a") - 0.05 - 1e-12, F.lit(False)).alias("regressed"))


@register("SELECT source, strftime(retrieved_at, '%Y-%m') AS month, count(*) AS documents, round(count(*) / ((epoch_us(max(retrieved_at)) - epoch_us(min(retrieved_at))) / 6e7 + 1), 9) AS per_minute FROM documents GROUP BY ALL")
def run_rates(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("retrieved_at").cast("timestamp")
    span = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 6e7 + 1
    return table(spark, folder, "documents").groupBy("source", F.date_format("retrieved_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("documents"), F.round(F.count("*") / span, 9).alias("per_minute"))


@register("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A wide aggregation over the largest relational table, for throughput."""
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


QUERIES, ORACLE = register.queries, register.sql
