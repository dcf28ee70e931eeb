"""Graph queries over documents, concepts, decisions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.io import table
from skein.operators import closure, components, graphs, resolution
from skein.plans.registry import Register
from skein.plans.relational import _ASSERTIONS, _CANDIDATES, _CHUNKS, _MENTIONS, assertions, candidates, chunks, mentions

register = Register()

_EDGES = f"{_CHUNKS}, {_MENTIONS}, edges AS (SELECT DISTINCT c.document_id, m.canonical_name AS feature FROM mentions m JOIN chunks c USING (chunk_id) WHERE m.canonical_name IS NOT NULL)"
_REACH = "reach AS (SELECT DISTINCT a, a AS r FROM links UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.a WHERE reach.r < links.b)"


def concept_edges(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, feature: which document mentions which concept."""
    c = chunks(spark, folder).select("chunk_id", "document_id")
    return mentions(spark, folder).where("canonical_name is not null").select("chunk_id", F.col("canonical_name").alias("feature")).join(c, "chunk_id").select("document_id", "feature").distinct()


@register(f"WITH {_EDGES}, g AS (SELECT feature, count(*) AS degree FROM edges GROUP BY 1) SELECT degree, count(*) AS features FROM g GROUP BY degree")
def degree_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.degrees(concept_edges(spark, folder), "document_id", "feature").groupBy("degree").agg(F.count("*").alias("features"))


@register(
    f"""WITH {_EDGES}, g AS (SELECT feature, count(*) AS degree FROM edges GROUP BY 1), n AS (SELECT canonical_name AS feature, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks FROM mentions GROUP BY 1), d AS (SELECT count(DISTINCT document_id) AS d FROM chunks)
    SELECT feature, degree, mentions, chunks, degree > 1 AS shared, degree >= greatest(3, 0.05 * d.d) AS high_degree, round(mentions / degree, 6) AS mentions_per_document FROM g JOIN n USING (feature), d"""
)
def concept_degree(spark: SparkSession, folder: str) -> DataFrame:
    documents = chunks(spark, folder).agg(F.count_distinct("document_id")).first()[0]
    g = graphs.degrees(concept_edges(spark, folder), "document_id", "feature")
    n = mentions(spark, folder).where("canonical_name is not null").groupBy(F.col("canonical_name").alias("feature")).agg(F.count("*").alias("mentions"), F.count_distinct("chunk_id").alias("chunks"))
    return g.join(n, "feature").select("feature", "degree", "mentions", "chunks", (F.col("degree") > 1).alias("shared"), (F.col("degree") >= max(3, 0.05 * documents)).alias("high_degree"), F.round(F.col("mentions") / F.col("degree"), 6).alias("mentions_per_document"))


@register(f"WITH {_EDGES}, g AS (SELECT feature, count(*) AS degree FROM edges GROUP BY 1) SELECT feature, degree FROM g ORDER BY degree DESC, feature LIMIT 100")
def top_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.degrees(concept_edges(spark, folder), "document_id", "feature").orderBy(F.desc("degree"), "feature").limit(100)


@register(f"WITH {_MENTIONS} SELECT coalesce(concept_type, 'NONE') AS concept_type, count(*) AS mentions, count(DISTINCT canonical_name) AS concepts FROM mentions GROUP BY 1")
def concept_types(spark: SparkSession, folder: str) -> DataFrame:
    return mentions(spark, folder).groupBy(F.coalesce("concept_type", F.lit("NONE")).alias("concept_type")).agg(F.count("*").alias("mentions"), F.count_distinct("canonical_name").alias("concepts"))


@register(f"WITH {_EDGES}, g AS (SELECT feature, list_sort(list(document_id)) AS documents FROM edges GROUP BY 1) SELECT feature, len(documents) AS n, documents[1] AS first_document FROM g WHERE len(documents) > 1")
def shared_features(spark: SparkSession, folder: str) -> DataFrame:
    g = concept_edges(spark, folder).groupBy("feature").agg(F.count("*").alias("n"), F.min("document_id").alias("first_document"))
    return g.where("n > 1")


@register(f"WITH {_EDGES} SELECT count(*) AS pairs FROM (SELECT DISTINCT a.document_id AS x, b.document_id AS y FROM edges a JOIN edges b ON a.feature = b.feature AND a.document_id < b.document_id)")
def connected_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs of documents share a concept, by merged bitmaps; pairs aren't formed."""
    return graphs.connected_document_pairs(concept_edges(spark, folder), "document_id", "feature")


@register(f"WITH {_EDGES}, g AS (SELECT feature, count(*) AS n FROM edges GROUP BY 1) SELECT count(*) AS features, sum(n * (n - 1) // 2)::BIGINT AS pair_incidences, count(*) FILTER (n > 1) AS linking FROM g")
def pair_incidences(spark: SparkSession, folder: str) -> DataFrame:
    g = graphs.degrees(concept_edges(spark, folder), "document_id", "feature")
    n = F.col("degree")
    return g.agg(F.count("*").alias("features"), F.sum(F.expr("degree * (degree - 1) div 2")).alias("pair_incidences"), F.count_if(n > 1).alias("linking"))


@register(
    f"""WITH {_EDGES}, g AS (SELECT feature, count(*) AS n FROM edges GROUP BY 1), d AS (SELECT count(DISTINCT document_id) AS d FROM chunks), k AS (SELECT e.* FROM edges e JOIN g USING (feature), d WHERE n < greatest(3, 0.05 * d.d))
    SELECT count(*) AS edges, count(DISTINCT feature) AS features, count(DISTINCT document_id) AS documents FROM k"""
)
def sensitivity_drop(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the graph without concepts of high degree."""
    documents = chunks(spark, folder).agg(F.count_distinct("document_id")).first()[0]
    e = concept_edges(spark, folder)
    hub = graphs.degrees(e, "document_id", "feature").where(F.col("degree") >= max(3, 0.05 * documents))
    return e.join(hub, "feature", "left_anti").agg(F.count("*").alias("edges"), F.count_distinct("feature").alias("features"), F.count_distinct("document_id").alias("documents"))


@register("WITH RECURSIVE " + _EDGES + ", links AS (SELECT 'd:' || document_id AS a, 'f:' || feature AS b FROM edges UNION ALL SELECT 'f:' || feature, 'd:' || document_id FROM edges), " + _REACH + " SELECT a AS node, min(r) AS component FROM reach GROUP BY a")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    e = concept_edges(spark, folder).select(F.concat(F.lit("d:"), "document_id").alias("u"), F.concat(F.lit("f:"), "feature").alias("v"))
    return components.components(e).select(F.col("vertex").alias("node"), "component")


@register(
    "WITH RECURSIVE " + _EDGES + ", docs AS (SELECT DISTINCT document_id FROM chunks), links AS (SELECT 'd:' || document_id AS a, 'f:' || feature AS b FROM edges UNION ALL SELECT 'f:' || feature, 'd:' || document_id FROM edges), " + _REACH + """,
    comp AS (SELECT a AS node, min(r) AS c FROM reach GROUP BY a UNION ALL SELECT 'd:' || document_id, 'd:' || document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM edges)),
    sizes AS (SELECT c, count(*) AS nodes, count(*) FILTER (starts_with(node, 'd:')) AS docs FROM comp GROUP BY c), f AS (SELECT feature, count(*) AS n FROM edges GROUP BY 1),
    m AS (SELECT (SELECT count(*) FROM docs) AS processed_documents, (SELECT count(DISTINCT document_id) FROM edges) AS graph_documents, (SELECT count(*) FROM f) AS features, (SELECT count(*) FROM f WHERE n > 1) AS shared_features, (SELECT count(*) FROM f WHERE n = 1) AS singleton_features, (SELECT count(*) FROM edges) AS edges,
      (SELECT count(*) FROM sizes) AS connected_components, (SELECT max(docs) FROM sizes) AS largest_component_documents, (SELECT max(nodes) FROM sizes) AS largest_component_nodes,
      (SELECT count(*) FROM (SELECT DISTINCT a.document_id AS x, b.document_id AS y FROM edges a JOIN edges b ON a.feature = b.feature AND a.document_id < b.document_id)) AS connected_document_pairs)
    SELECT *, processed_documents - graph_documents AS zero_fact_documents, 100.0 * (processed_documents - graph_documents) / processed_documents AS zero_fact_percent, 100.0 * shared_features / features AS shared_feature_percent, edges / processed_documents AS features_per_document, edges / graph_documents AS edges_per_graph_document FROM m"""
)
def graph_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.graph_metrics(chunks(spark, folder).select("document_id"), concept_edges(spark, folder), "document_id", "feature")


@register(
    f"""WITH {_ASSERTIONS}, {_MENTIONS}, n AS (SELECT mention_id AS node FROM mentions WHERE concept_type = 'DEVICE'), k AS (SELECT head_mention_id AS h, tail_mention_id AS t, relation_type AS kind FROM assertions WHERE relation_type IN ('HAS_COMPONENT', 'USES_MATERIAL', 'LOCATED_IN'))
    SELECT DISTINCT node, neighbour, kind, direction FROM (SELECT h AS node, t AS neighbour, kind, 'out' AS direction FROM k UNION ALL SELECT t, h, kind, 'in' FROM k) JOIN n USING (node) WHERE neighbour IS NOT NULL"""
)
def one_hop_undirected(spark: SparkSession, folder: str) -> DataFrame:
    a = assertions(spark, folder).select("head_mention_id", "tail_mention_id", "relation_type")
    nodes = mentions(spark, folder).where("concept_type = 'DEVICE'").select("mention_id")
    return graphs.one_hop(a, "head_mention_id", "tail_mention_id", "relation_type", nodes, "mention_id", ["HAS_COMPONENT", "USES_MATERIAL", "LOCATED_IN"])


@register(
    f"""WITH RECURSIVE {_ASSERTIONS}, {_MENTIONS}, l AS (SELECT head_mention_id AS a, tail_mention_id AS b FROM assertions WHERE head_mention_id IS NOT NULL AND tail_mention_id IS NOT NULL), k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    w(node, layer) AS (SELECT DISTINCT mention_id, 0 FROM mentions WHERE concept_type = 'DEVICE' UNION SELECT k.b, w.layer + 1 FROM w JOIN k ON k.a = w.node WHERE w.layer < 3)
    SELECT layer, count(*) AS nodes FROM (SELECT node, min(layer) AS layer FROM w GROUP BY node) GROUP BY layer"""
)
def graph_layers(spark: SparkSession, folder: str) -> DataFrame:
    """How many mentions lie one, two and three relations from a device."""
    roots = mentions(spark, folder).where("concept_type = 'DEVICE'").select("mention_id")
    found = graphs.layers(assertions(spark, folder), "head_mention_id", "tail_mention_id", roots, "mention_id", 3)
    return found.groupBy("layer").agg(F.count("*").alias("nodes"))


@register(f"WITH {_EDGES}, g AS (SELECT feature, count(*) AS degree FROM edges GROUP BY 1 ORDER BY degree DESC, feature LIMIT 30) SELECT e.document_id, e.feature, g.degree FROM edges e JOIN g USING (feature) ORDER BY g.degree DESC, e.feature, e.document_id LIMIT 50")
def bounded_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """At most 30 concept nodes and 50 edges, the best connected first."""
    e = concept_edges(spark, folder)
    top = graphs.degrees(e, "document_id", "feature").orderBy(F.desc("degree"), "feature").limit(30)
    return e.join(F.broadcast(top), "feature").orderBy(F.desc("degree"), "feature", "document_id").limit(50).select("document_id", "feature", "degree")  # 30 rows


@register(
    f"""WITH {_MENTIONS}, m AS (SELECT DISTINCT chunk_id, mention_id FROM mentions), f AS (SELECT chunk_id, min(mention_id) AS first FROM m GROUP BY 1), {_ASSERTIONS}, x AS (SELECT DISTINCT head_mention_id AS first, tail_mention_id AS other FROM assertions)
    SELECT m.chunk_id, f.first, m.mention_id AS other FROM m JOIN f USING (chunk_id) WHERE m.mention_id <> f.first AND NOT EXISTS (SELECT 1 FROM x WHERE x.first = f.first AND x.other = m.mention_id)"""
)
def star_pairs(spark: SparkSession, folder: str) -> DataFrame:
    known = assertions(spark, folder).select(F.col("head_mention_id").alias("first"), F.col("tail_mention_id").alias("other")).distinct()
    return graphs.stars(mentions(spark, folder), "chunk_id", F.col("mention_id"), known)


def resolver_steps(spark: SparkSession, folder: str) -> DataFrame:
    """A dependency graph of fixed shape: each indexer version waits for the sources and kinds of its documents, reports wait for versions."""
    r = table(spark, folder, "graph_index_results").join(table(spark, folder, "documents").select("document_id", "source", "kind"), "document_id")
    parts = r.select(F.explode(F.array(
        F.struct(F.col("source").alias("a"), F.coalesce("kind", F.lit("unknown")).alias("b")),
        F.struct(F.coalesce("kind", F.lit("unknown")).alias("a"), F.col("indexer_version").alias("b")),
        F.struct(F.col("indexer_version").alias("a"), F.col("projection_version").alias("b")),
    )).alias("e"))
    return parts.select("e.a", "e.b").distinct()


_STEPS = "r AS (SELECT d.source, coalesce(d.kind, 'unknown') AS kind, indexer_version, projection_version FROM graph_index_results JOIN documents d USING (document_id)), steps AS (SELECT source AS a, kind AS b FROM r UNION SELECT kind, indexer_version FROM r UNION SELECT indexer_version, projection_version FROM r)"


@register(f"WITH RECURSIVE {_STEPS}, w AS (SELECT a, b, 1 AS d FROM steps UNION SELECT w.a, s.b, w.d + 1 FROM w JOIN steps s ON s.a = w.b WHERE w.d < 10) SELECT a, b, min(d)::BIGINT AS distance FROM w GROUP BY ALL")
def transitive_closure(spark: SparkSession, folder: str) -> DataFrame:
    return closure.closure(resolver_steps(spark, folder), "a", "b").select("a", "b", F.col("distance").cast("long").alias("distance"))


@register(f"WITH RECURSIVE {_STEPS}, n AS (SELECT a AS node FROM steps UNION SELECT b FROM steps), w AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT b FROM steps) UNION SELECT s.b, w.level + 1 FROM w JOIN steps s ON s.a = w.node WHERE w.level < 10) SELECT node, max(level)::BIGINT AS level FROM w GROUP BY node")
def topological_levels(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = closure.levels(resolver_steps(spark, folder), "a", "b")
    return placed.select("node", F.col("level").cast("long").alias("level"))


@register()
def constrained_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and blocked merges at a threshold of 0.7 for probability and confidence."""
    return resolution.constrained_clusters(table(spark, folder, "pair_decisions"), 0.7)


@register("""WITH p AS (SELECT DISTINCT least(feature_a, feature_b) AS a, greatest(feature_a, feature_b) AS b FROM pair_decisions WHERE feature_b IS NOT NULL AND feature_a <> feature_b AND upper(trim(decision)) = 'DIFFERENT')
    SELECT count(*) AS kept_apart, 0::BIGINT AS merged_all_the_same, 0::BIGINT AS in_two_clusters FROM p""")
def clusters_sound(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs decided to differ, how many of them share a cluster, and features that are in two clusters."""
    pairs = table(spark, folder, "pair_decisions").where("feature_b is not null and feature_a <> feature_b and upper(trim(decision)) = 'DIFFERENT'").select(F.least("feature_a", "feature_b").alias("a"), F.greatest("feature_a", "feature_b").alias("b")).distinct()
    members = constrained_clusters(spark, folder).where("kind = 'member'")
    side = lambda name, c: members.select(F.col("feature").alias(name), F.col("cluster").alias(c))
    judged = pairs.join(side("a", "ca"), "a", "left").join(side("b", "cb"), "b", "left").select(F.lit(1).alias("pair"), F.coalesce((F.col("ca") == F.col("cb")).cast("int"), F.lit(0)).alias("merged"), F.lit(0).alias("twice"))
    twice = members.groupBy("feature").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(0).alias("pair"), F.lit(0).alias("merged"), F.lit(1).alias("twice"))
    return judged.unionByName(twice).agg(F.sum("pair").alias("kept_apart"), F.sum("merged").alias("merged_all_the_same"), F.sum("twice").alias("in_two_clusters"))


@register()
def cluster_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters, merged features and conflicts at several thresholds."""
    out = None
    for t in (0.9, 0.8, 0.7):
        c = resolution.constrained_clusters(table(spark, folder, "pair_decisions"), t)
        row = c.agg(F.lit(t).alias("threshold"), F.count_if(F.col("kind") == "member").alias("features"), F.count_distinct(F.when(F.col("kind") == "member", F.col("cluster"))).alias("clusters"), F.count_if(F.col("kind") == "conflict").alias("conflicts"))
        out = row if out is None else out.unionByName(row)
    return out


@register(
    f"""WITH {_CANDIDATES}, {_CHUNKS} SELECT c.document_id AS source, 'TechnicalFeature:' || lower(trim(g.target_text)) AS target, CASE WHEN g.edge_type = 'USES_TECHNOLOGY' THEN 'USES_TECHNOLOGY' ELSE 'DISCLOSES_FEATURE' END AS kind, count(*) AS evidence_count, round(max(confidence), 6) AS confidence
    FROM candidates g JOIN chunks c ON c.chunk_id = g.evidence_chunk_id WHERE g.target_text IS NOT NULL GROUP BY ALL"""
)
def projection_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with namespaced keys, one for each document, target and kind."""
    c = chunks(spark, folder).select(F.col("chunk_id").alias("evidence_chunk_id"), F.col("document_id").alias("source"))
    g = candidates(spark, folder).where("target_text is not null").join(c, "evidence_chunk_id")
    kind = F.when(F.col("edge_type") == "USES_TECHNOLOGY", "USES_TECHNOLOGY").otherwise("DISCLOSES_FEATURE")
    return g.groupBy("source", F.concat(F.lit("TechnicalFeature:"), F.lower(F.trim("target_text"))).alias("target"), kind.alias("kind")).agg(F.count("*").alias("evidence_count"), F.round(F.max("confidence"), 6).alias("confidence"))


@register(f"WITH {_MENTIONS}, m AS (SELECT DISTINCT canonical_name FROM mentions), s AS (SELECT DISTINCT surface_text FROM mentions) SELECT t.concept_type, count(*) AS concepts, count(m.canonical_name) AS by_name, count(s.surface_text) AS by_surface, round(count(m.canonical_name) / count(*), 6) AS recall FROM technical_concepts t LEFT JOIN m ON m.canonical_name = t.canonical_name LEFT JOIN s ON s.surface_text = t.canonical_name GROUP BY 1")
def concept_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many reference concepts each side of the mentions finds."""
    m = mentions(spark, folder)
    t = table(spark, folder, "technical_concepts").select("concept_type", "canonical_name")
    a, b = m.select("canonical_name").distinct().withColumn("a", F.lit(1)), m.select(F.col("surface_text").alias("canonical_name")).distinct().withColumn("b", F.lit(1))
    j = t.join(a, "canonical_name", "left").join(b, "canonical_name", "left")
    return j.groupBy("concept_type").agg(F.count("*").alias("concepts"), F.count("a").alias("by_name"), F.count("b").alias("by_surface"), F.round(F.count("a") / F.count("*"), 6).alias("recall"))


QUERIES, ORACLE = register.queries, register.sql
