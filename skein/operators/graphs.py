"""Document-feature graphs: degrees, metrics, neighbours, exact pair counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.session import cut


def degrees(edges: DataFrame, document: str, feature: str) -> DataFrame:
    """feature, degree: in how many documents each feature occurs."""
    return edges.select(document, feature).distinct().groupBy(feature).agg(F.count("*").alias("degree"))


def connected_document_pairs(edges: DataFrame, document: str, feature: str) -> DataFrame:
    """pairs: how many different pairs of documents share at least one feature; no pair is formed.

    Documents get dense integers. Every feature has bitmaps of its documents in ranges of 32,768. Documents with the same
    set of features form one class, for which the bitmaps of its features are merged once; the bits set, less the document
    itself, are the partners of each document of the class. A class has at most one bitmap of 4 KB for each range its
    partners lie in, so in the worst case, all sets different and all documents linked, the bitmaps take one bit a pair.
    """
    links = edges.select(F.col(document).alias("d"), F.col(feature).alias("f")).distinct()
    classes = links.groupBy("d").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    buckets = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = _dense(classes, "d", buckets)
    bits = numbered.select("id", F.explode("fs").alias("f")).groupBy("f", F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits"))
    kinds = classes.groupBy("fs").agg(F.count("*").alias("documents")).select("fs", "documents", F.xxhash64("fs").alias("c"))
    merged = kinds.select("c", "documents", F.explode("fs").alias("f")).join(bits, "f").groupBy("c", "documents", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    partners = merged.groupBy("c", "documents").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))
    return partners.agg(F.coalesce((F.sum((F.col("n") - 1) * F.col("documents")) / 2).cast("long"), F.lit(0)).alias("pairs"))


def _dense(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows with an id: dense within a hash bucket, buckets far apart."""
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    placed = rows.withColumn("_b", bucket)
    return placed.withColumn("id", F.col("_b").cast("long") * (1 << 32) + F.row_number().over(Window.partitionBy("_b").orderBy(key))).drop("_b")


def graph_metrics(documents: DataFrame, edges: DataFrame, document: str, feature: str) -> DataFrame:
    """One row of counts and ratios of a document-feature graph. Documents without features are isolated nodes."""
    links = edges.select(F.col(document).alias("d"), F.col(feature).alias("f")).distinct()
    docs = documents.select(F.col(document).alias("d")).distinct()
    per_feature = links.groupBy("f").agg(F.count("*").alias("n"))
    features = per_feature.agg(F.count("*").alias("features"), F.count_if(F.col("n") > 1).alias("shared_features"), F.count_if(F.col("n") == 1).alias("singleton_features"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    with_facts = docs.join(links.select("d").distinct(), "d", "left_semi").agg(F.count("*").alias("graph_documents"))
    all_docs = docs.agg(F.count("*").alias("processed_documents"))
    nodes = links.select(F.concat(F.lit("d:"), "d").alias("u"), F.concat(F.lit("f:"), "f").alias("v"))
    found = components(nodes, docs.select(F.concat(F.lit("d:"), "d").alias("vertex")))
    sizes = found.groupBy("component").agg(F.count("*").alias("nodes"), F.count_if(F.col("vertex").startswith("d:")).alias("docs"))
    shape = sizes.agg(F.count("*").alias("connected_components"), F.max("docs").alias("largest_component_documents"), F.max("nodes").alias("largest_component_nodes"))
    pairs = connected_document_pairs(links, "d", "f").select(F.col("pairs").alias("connected_document_pairs"))
    rows = [part.first().asDict() for part in (all_docs, with_facts, features, shape, pairs)]  # one row each
    m: dict = {k: v for r in rows for k, v in r.items()}
    n, g = m["processed_documents"], m["graph_documents"]
    m["zero_fact_documents"] = n - g
    m["zero_fact_percent"] = 100.0 * (n - g) / n if n else 0.0
    m["shared_feature_percent"] = 100.0 * m["shared_features"] / m["features"] if m["features"] else 0.0
    m["features_per_document"] = m["edges"] / n if n else 0.0
    m["edges_per_graph_document"] = m["edges"] / g if g else 0.0
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in m.items())
    return documents.sparkSession.createDataFrame([tuple(m.values())], kinds)


def one_hop(edges: DataFrame, source: str, target: str, kind: str, nodes: DataFrame, node: str, kinds: list[str]) -> DataFrame:
    """node, neighbour, kind, direction: undirected neighbours of the given nodes over edges of the allowed kinds."""
    allowed = edges.where(F.col(kind).isin(kinds))
    wanted = nodes.select(F.col(node).alias("node")).distinct()
    out = allowed.select(F.col(source).alias("node"), F.col(target).alias("neighbour"), F.col(kind).alias("kind"), F.lit("out").alias("direction"))
    back = allowed.select(F.col(target).alias("node"), F.col(source).alias("neighbour"), F.col(kind).alias("kind"), F.lit("in").alias("direction"))
    return out.unionByName(back).where("node is not null and neighbour is not null").join(wanted, "node", "left_semi").distinct()


def stars(rows: DataFrame, group: str, member: Column, existing: DataFrame | None = None) -> DataFrame:
    """group, first, other: the smallest member of each group linked to every other one, without pairs that exist already."""
    members = rows.select(group, member.alias("other")).where("other is not null").distinct()
    first = members.groupBy(group).agg(F.min("other").alias("first"))
    links = members.join(first, group).where("other != first").select(group, "first", "other")
    return links if existing is None else links.join(existing, ["first", "other"], "left_anti").select(group, "first", "other")


def layers(edges: DataFrame, source: str, target: str, roots: DataFrame, root: str, depth: int) -> DataFrame:
    """node, layer: nodes within depth steps of the roots over undirected edges, each in its nearest layer; roots are in layer 0.

    One join a layer with the newest layer only; a hub's edges meet it by key and may be split by adaptive execution.
    """
    links = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = newest = cut(roots.select(F.col(root).alias("node")).where("node is not null").distinct().withColumn("layer", F.lit(0)))
    for layer in range(1, depth + 1):
        step = newest.select(F.col("node").alias("a")).join(links, "a").select(F.col("b").alias("node")).distinct()
        newest = cut(step.join(known, "node", "left_anti").withColumn("layer", F.lit(layer)))
        known = known.unionByName(newest)
    return known
