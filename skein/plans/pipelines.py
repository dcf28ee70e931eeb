"""Longer flows: loading a corpus, canonicalizing a graph, assembling run graphs and snapshots, injected models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import models
from skein.functions import text as tx
from skein.io import table
from skein.operators import lexical, resolution, snapshots
from skein.plans.registry import Register
from skein.plans.relational import _ASSERTIONS, _CANDIDATES, _CHUNKS, _EVIDENCE, _MENTIONS, assertions, candidates, chunks, evidence, mentions
from skein.plans.retrieval import _TERMS, QUERY

register = Register()


@register(
    """WITH e AS (SELECT source, title IS NOT NULL AND trim(title) <> '' AND length(trim(text)) >= 80 AS ok, sha256(text) AS h, external_id FROM documents)
    SELECT source, count(*) AS seen, count(*) FILTER (ok) AS eligible, count(DISTINCT (external_id, h)) FILTER (ok) AS loaded, count(DISTINCT h) FILTER (ok) AS contents FROM e GROUP BY source"""
)
def corpus_load(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of a load: seen, eligible, loaded once each, different contents."""
    ok = F.coalesce((F.trim("title") != "") & (F.char_length(F.trim("text")) >= 80), F.lit(False))
    e = table(spark, folder, "documents").select("source", ok.alias("ok"), F.sha2("text", 256).alias("h"), "external_id")
    per = e.groupBy("source", "ok", "external_id", "h").agg(F.count("*").alias("n"))
    by = per.groupBy("source", "ok").agg(F.sum("n").alias("n"), F.count("*").alias("identities"), F.count_distinct("h").alias("contents"))
    pick = lambda c: F.sum(F.when(F.col("ok"), F.col(c)).otherwise(0))
    return by.groupBy("source").agg(F.sum("n").alias("seen"), pick("n").alias("eligible"), pick("identities").alias("loaded"), pick("contents").alias("contents"))


@register()
def loaded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The load itself: eligible documents, each identity once, in chunks with vectors of a stand-in model."""
    d = table(spark, folder, "documents").where((F.trim("title") != "") & (F.char_length(F.trim("text")) >= 80))
    d = d.select("doc_id", "source", "external_id", "text", F.sha2("text", 256).alias("content_hash"), tx.language_or_guess(F.col("lang"), F.col("text")).alias("language"))
    none = d.select("source", "external_id", "content_hash").limit(0)
    once = snapshots.new_only(d, none, ["source", "external_id", "content_hash"], [F.col("doc_id")])
    s = once.select("doc_id", "content_hash", "language", "text", F.posexplode(tx.chunks_of("text", "language")).alias("ordinal", "s"))
    part = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    c = s.select("doc_id", "content_hash", "language", "ordinal", part.alias("chunk"))
    v = c.withColumn("vector", models.embedder(models.hashed_terms(16), 16)("chunk"))
    return v.select("doc_id", "ordinal", "language", F.sha2("chunk", 256).alias("hash"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@register()
def canonical_features(spark: SparkSession, folder: str) -> DataFrame:
    """Every decided feature with its canonical one and how it was resolved."""
    p = table(spark, folder, "pair_decisions").where("feature_b is not null")
    c = resolution.constrained_clusters(p, 0.8)
    members = c.where("kind = 'member'").select("feature", "cluster")
    blocked = c.where("kind = 'conflict'").select(F.explode(F.array("feature", "cluster")).alias("feature")).distinct().withColumn("blocked", F.lit(True))
    size = members.groupBy("cluster").agg(F.count("*").alias("members"))
    every = p.select(F.explode(F.array("feature_a", "feature_b")).alias("feature")).distinct()
    j = every.join(members, "feature", "left").join(size, "cluster", "left").join(blocked, "feature", "left")
    method = F.when(F.col("members") > 1, "merged").when(F.col("blocked"), "blocked").otherwise("own")
    return j.select("feature", F.coalesce("cluster", "feature").alias("canonical"), F.coalesce("members", F.lit(1)).alias("members"), method.alias("method"))


@register(f"WITH {_EVIDENCE} SELECT document_id, count(*) AS evidence, array_to_string(list(evidence_id ORDER BY coalesce(score, 0) DESC, evidence_id), ',') AS ordered FROM evidence GROUP BY document_id")
def evidence_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of each document in order; a document's list is bounded by retrieval."""
    rows = F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "evidence_id")))
    return evidence(spark, folder).groupBy("document_id").agg(F.count("*").alias("evidence"), F.array_join(F.transform(rows, lambda r: r["evidence_id"]), ",").alias("ordered"))


@register(f"WITH {_CHUNKS} SELECT revision_id, count(*) AS chunks, array_to_string(list(chunk_id ORDER BY section, ordinal, chunk_id), ',') AS chunk_ids, sum(length(text))::BIGINT AS characters FROM chunks GROUP BY revision_id")
def nested_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("section", "ordinal", "chunk_id")))
    return chunks(spark, folder).groupBy("revision_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(rows, lambda r: r["chunk_id"]), ",").alias("chunk_ids"), F.sum(F.char_length("text")).alias("characters"))


@register(f"WITH {_CANDIDATES}, {_CHUNKS} SELECT c.document_id, sha256(array_to_string(list_sort(list_distinct(list(lower(trim(g.target_text))))), '|')) AS state_hash FROM candidates g JOIN chunks c ON c.chunk_id = g.evidence_chunk_id WHERE g.target_text IS NOT NULL GROUP BY c.document_id")
def state_hash(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of each document's features that neither order nor repeats change."""
    c = chunks(spark, folder).select(F.col("chunk_id").alias("evidence_chunk_id"), "document_id")
    g = candidates(spark, folder).where("target_text is not null").join(c, "evidence_chunk_id")
    return g.groupBy("document_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("target_text")))), "|"), 256).alias("state_hash"))


@register(
    f"""WITH {_EVIDENCE}, x AS (SELECT evidence_id, unnest(channels) AS channel, chunk_id, language, section FROM evidence)
    SELECT evidence_id, channel, CASE WHEN channel = 'graph' AND chunk_id IS NULL THEN 'GRAPH_WITHOUT_CHUNK' WHEN channel = 'dense' AND language IS NULL THEN 'DENSE_WITHOUT_LANGUAGE' WHEN channel = 'lexical' AND section = 'title' THEN 'LEXICAL_ON_TITLE' END AS reason FROM x WHERE reason IS NOT NULL"""
)
def channel_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Rules over exploded records, with a reason for each that breaks one."""
    x = evidence(spark, folder).select("evidence_id", F.explode("channels").alias("channel"), "chunk_id", "language", "section")
    reason = F.when((F.col("channel") == "graph") & F.col("chunk_id").isNull(), "GRAPH_WITHOUT_CHUNK").when((F.col("channel") == "dense") & F.col("language").isNull(), "DENSE_WITHOUT_LANGUAGE").when((F.col("channel") == "lexical") & (F.col("section") == "title"), "LEXICAL_ON_TITLE")
    return x.select("evidence_id", "channel", reason.alias("reason")).where("reason is not null")


@register("WITH c AS (SELECT DISTINCT cluster_id, canonical_key, document_count FROM feature_clusters), k AS (SELECT split_part(canonical_key, ':', 1) AS namespace, split_part(canonical_key, ':', 2) AS key FROM c) SELECT k.namespace, k.key, c.cluster_id, coalesce(c.document_count, -1)::BIGINT AS documents FROM k JOIN c ON left(c.cluster_id, length(k.key)) = k.key AND length(k.key) = 18")
def keyed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Opaque keys taken apart and looked up by their prefix, as an equi-join."""
    c = table(spark, folder, "feature_clusters").select("cluster_id", "canonical_key", "document_count").distinct()
    k = c.select(F.split_part("canonical_key", F.lit(":"), F.lit(1)).alias("namespace"), F.split_part("canonical_key", F.lit(":"), F.lit(2)).alias("key")).where(F.char_length("key") == 18)
    return k.join(c.select(F.left("cluster_id", F.lit(18)).alias("key"), "cluster_id", F.coalesce("document_count", F.lit(-1)).cast("long").alias("documents")), "key").select("namespace", "key", "cluster_id", "documents")


@register("WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'click')) SELECT v.user_id, v.n AS place, v.event_id AS view_id, c.event_id AS click_id FROM s v JOIN s c ON c.user_id = v.user_id AND c.n = v.n AND v.event_type = 'view' AND c.event_type = 'click'")
def positional_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Two lists of each user put side by side by place."""
    from skein.operators.ranking import ranked

    e = table(spark, folder, "events").where(F.col("event_type").isin("view", "click")).select("user_id", "event_type", "event_id", "ts")
    s = ranked(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "place")
    side = lambda kind, name: s.where(F.col("event_type") == kind).select("user_id", "place", F.col("event_id").alias(name))
    return side("view", "view_id").join(side("click", "click_id"), ["user_id", "place"]).select("user_id", "place", "view_id", "click_id")


@register("""WITH p AS (SELECT *, CASE WHEN fact_count % 10 = 3 THEN fact_count + 1 ELSE fact_count END AS facts FROM graph_index_results)
    SELECT count(*) AS revisions, 2 * count(*) FILTER (facts <> fact_count) AS changed_facts, count(*) FILTER (extraction_splits IS NULL) AS promoted, count(*) FILTER (facts <> fact_count) = 0 AS metadata_only FROM p""")
def promotion_check(spark: SparkSession, folder: str) -> DataFrame:
    """A promotion that may touch metadata only, but changes some facts: rows of either version that the other lacks."""
    base = table(spark, folder, "graph_index_results")
    spoilt = F.when(F.col("fact_count") % 10 == 3, F.col("fact_count") + 1).otherwise(F.col("fact_count"))
    promoted = base.withColumn("extraction_splits", F.coalesce("extraction_splits", F.lit(0))).withColumn("fact_count", spoilt)
    facts = ["revision_id", "document_id", "fact_count", "indexer_version"]
    changed = snapshots.symmetric_difference(base.select(facts), promoted.select(facts)).select(F.lit(0).alias("revision"), F.lit(1).alias("changed"), F.lit(0).alias("bare"))
    rows = base.select(F.lit(1).alias("revision"), F.lit(0).alias("changed"), F.col("extraction_splits").isNull().cast("int").alias("bare")).unionByName(changed)
    return rows.agg(F.sum("revision").alias("revisions"), F.sum("changed").alias("changed_facts"), F.sum("bare").alias("promoted"), (F.sum("changed") == 0).alias("metadata_only"))


#: Which concept types a relation may end at. Fixed values.
RELATION_TAILS = {"USES_MATERIAL": ["MATERIAL", "ANALYTE"], "HAS_PROPERTY": ["PROPERTY", "PERFORMANCE"], "USED_FOR": ["APPLICATION"], "HAS_MORPHOLOGY": ["MORPHOLOGY"], "HAS_MECHANISM": ["MECHANISM"]}
_TAILS = " OR ".join(f"(relation_type = '{r}' AND m.concept_type IN ({', '.join(repr(t) for t in ts)}))" for r, ts in RELATION_TAILS.items())


@register(f"WITH {_ASSERTIONS}, {_MENTIONS} SELECT relation_type, count(*) AS judged, count(*) FILTER (NOT coalesce({_TAILS}, false)) AS broken FROM assertions a JOIN mentions m ON m.mention_id = a.tail_mention_id WHERE relation_type IN ({', '.join(repr(r) for r in RELATION_TAILS)}) GROUP BY relation_type")
def relation_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Relations whose end has a type that the rules don't allow."""
    rules = spark.createDataFrame([(r, t, True) for r, ts in RELATION_TAILS.items() for t in ts], "relation_type string, concept_type string, allowed boolean")
    a = assertions(spark, folder).where(F.col("relation_type").isin(list(RELATION_TAILS))).select("relation_type", F.col("tail_mention_id").alias("mention_id"))
    j = a.join(mentions(spark, folder).select("mention_id", "concept_type"), "mention_id").join(F.broadcast(rules), ["relation_type", "concept_type"], "left")  # fixed size: the rule list
    return j.groupBy("relation_type").agg(F.count("*").alias("judged"), F.count_if(F.col("allowed").isNull()).alias("broken"))


@register(
    f"""WITH {_CANDIDATES}, {_CHUNKS}, {_MENTIONS}, f AS (SELECT c.document_id, lower(trim(g.target_text)) AS feature, g.evidence_chunk_id AS chunk_id FROM candidates g JOIN chunks c ON c.chunk_id = g.evidence_chunk_id WHERE g.target_text IS NOT NULL),
    m AS (SELECT DISTINCT c.document_id, lower(trim(m.canonical_name)) AS feature, m.chunk_id FROM mentions m JOIN chunks c USING (chunk_id) WHERE m.canonical_name IS NOT NULL)
    SELECT f.document_id AS source, f.feature AS target, 'MATCHES' AS kind, count(DISTINCT f.chunk_id) AS evidence FROM f JOIN m ON f.document_id = m.document_id AND f.feature = m.feature AND f.chunk_id = m.chunk_id GROUP BY ALL"""
)
def run_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between documents and the features that facts and mentions agree on, with the chunks that both cite."""
    c = chunks(spark, folder).select("chunk_id", "document_id")
    f = candidates(spark, folder).where("target_text is not null").select(F.lower(F.trim("target_text")).alias("feature"), F.col("evidence_chunk_id").alias("chunk_id")).join(c, "chunk_id").distinct()
    m = mentions(spark, folder).where("canonical_name is not null").select(F.lower(F.trim("canonical_name")).alias("feature"), "chunk_id").distinct()
    both = f.join(m, ["chunk_id", "feature"])
    return both.groupBy(F.col("document_id").alias("source"), F.col("feature").alias("target")).agg(F.count_distinct("chunk_id").alias("evidence")).select("source", "target", F.lit("MATCHES").alias("kind"), "evidence")


@register("SELECT vec_id, label::BIGINT AS label, false AS changed FROM embeddings WHERE label % 4 <> 0 UNION ALL SELECT vec_id, label + 100, true FROM embeddings WHERE label % 4 = 0")
def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.lit(False).alias("changed"))
    new = e.where("label % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(True).alias("changed"))
    return snapshots.upsert(e, new, "vec_id")


@register()
def injected_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The best 100 pieces of evidence by an injected scorer; here shared terms by the root of the length."""

    def load():
        wanted = set(tx.term_list(QUERY))

        def score(_: str, texts: list[str]) -> list[float]:
            return [len(wanted & set(t)) / max(1, len(t)) ** 0.5 for t in map(tx.term_list, texts)]

        return score

    e = evidence(spark, folder).select("evidence_id", F.concat_ws("\n", "title", "section", "text").alias("t"))
    scored = e.select("evidence_id", F.round(models.scorer(load, QUERY)("t"), 9).alias("score"))
    return scored.orderBy(F.desc("score"), "evidence_id").limit(100)


@register(
    f"""WITH {_EVIDENCE}, p AS (SELECT document_id, f AS feature, coalesce(lower(text), '') AS t FROM evidence, (VALUES ('gas sensor'), ('thin film'), ('annealing')) v(f))
    SELECT document_id, feature, count(*) FILTER (contains(t, feature)) AS direct, count(*) FILTER (NOT contains(t, feature) AND len(list_filter(string_split(feature, ' '), lambda w: contains(t, w))) > 0) AS partial, count(*) AS n FROM p GROUP BY ALL"""
)
def relation_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's evidence against a fixed list of features, labelled by an injected classifier."""
    features = ["gas sensor", "thin film", "annealing"]

    def load():
        def run(rows: list[tuple]) -> list[str]:
            return ["direct" if f in (t or "").lower() else "partial" if any(w in (t or "").lower() for w in f.split()) else "none" for f, t in rows]

        return run

    pairs = evidence(spark, folder).select("evidence_id", "document_id", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"), "text")
    done = models.labelled(pairs, load, ["feature", "text"])
    return done.groupBy("document_id", "feature").agg(F.count_if(F.col("label") == "direct").alias("direct"), F.count_if(F.col("label") == "partial").alias("partial"), F.count("*").alias("n"))


#: Queries of the expanded search: the question and its features.
EXPANDED = models.expanded_queries(QUERY, [("humidity tolerance", 0.9), ("Response of the zno sensor to acetone", 0.8), ("spray pyrolysis", 0.7)])
_ASKED = ", ".join(f"({i}, '{t}')" for i, q in enumerate(EXPANDED) for t in tx.term_list(q))


@register(
    f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents), n AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM t), q(i, term) AS (VALUES {_ASKED}),
    f AS (SELECT doc_id, i, q.term, len(list_filter(terms, lambda x: x = q.term)) AS f, len(terms) AS l FROM t, q),
    d AS (SELECT term, count(DISTINCT doc_id) FILTER (f > 0) AS df FROM f GROUP BY term),
    s AS (SELECT doc_id, i, sum(CASE WHEN f > 0 THEN ln(1 + (n.n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al)) ELSE 0 END) AS score FROM f JOIN d USING (term), n GROUP BY ALL)
    SELECT doc_id, round(max(score), 6) AS score FROM s GROUP BY doc_id"""
)
def expanded_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best score of each document over the query and its weighted features, all scored at once."""
    scored = lexical.bm25_all(table(spark, folder, "documents").select("doc_id", "text"), tx.plain_terms(F.col("text")), EXPANDED)
    return scored.select("doc_id", F.round(F.array_max("scores"), 6).alias("score"))


@register("SELECT min(doc_id) AS doc_id, true AS numbered, true AS unit_length FROM documents WHERE trim(title) <> '' AND length(trim(text)) >= 80 GROUP BY source, external_id, text")
def loaded_once(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents the load keeps, each identity once; whether their chunks are numbered without gaps and their vectors have length 1 or 0."""
    c = loaded_chunks(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("places"), F.every(F.col("norm").isin(0.0, 1.0)).alias("unit_length"))
    return c.select("doc_id", ((F.col("n") == F.col("last") + 1) & (F.col("places") == F.col("n"))).alias("numbered"), "unit_length")


@register("SELECT f AS feature, 1::BIGINT AS n, true AS canonical_is_decided FROM (SELECT feature_a AS f FROM pair_decisions WHERE feature_b IS NOT NULL UNION SELECT feature_b FROM pair_decisions WHERE feature_b IS NOT NULL) WHERE f IS NOT NULL")
def canonical_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Every decided feature has one canonical feature, which is a decided one and its own."""
    c = canonical_features(spark, folder).where("feature is not null")
    own = c.where("feature = canonical").select(F.col("feature").alias("canonical"), F.lit(True).alias("own"))
    return c.join(own, "canonical", "left").groupBy("feature").agg(F.count("*").alias("n"), F.every(F.coalesce("own", F.lit(False))).alias("canonical_is_decided"))


QUERIES, ORACLE = register.queries, register.sql
