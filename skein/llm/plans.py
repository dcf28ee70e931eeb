"""Queries of the training-data problems."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.io import table
from skein.llm import groups, leaks, lookalikes, packing, pii, sentences, splitting, terms


#: A public tokenizer's rank file and the pattern by which it takes words apart; the environment may name others.
TOKENIZER = os.environ.get("SKEIN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
TOKEN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.connected_groups(groups.decided_matches(table(spark, folder, "pair_decisions")))


def _text_terms(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    clusters = table(spark, folder, "feature_clusters").where("cluster_id is not null").groupBy("cluster_id").agg(F.min_by(F.struct("canonical_text", "document_count"), F.struct("canonical_text", "document_count")).alias("c"))
    clusters = clusters.select("c.canonical_text", "c.document_count")
    return terms.term_counts(clusters, terms.words_of(F.col("canonical_text")), F.col("document_count")), clusters.count()


def _relation_terms(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    assertions = table(spark, folder, "annotations").where("assertion_id is not null").groupBy("assertion_id").agg(F.min("relation_type").alias("relation_type"))
    return terms.term_counts(assertions, F.array("relation_type")), assertions.count()


def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of both fields with its frequencies and mark."""
    words, clusters = _text_terms(spark, folder)
    values, assertions = _relation_terms(spark, folder)
    both = terms.marked(words, clusters, "weight").withColumn("field_name", F.lit("canonical_text")).unionByName(
        terms.marked(values, assertions, "records").withColumn("field_name", F.lit("relation_type"))
    )
    return both.select("field_name", "term", "occurrences", "records", "weight", "mark")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_terms(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(table(spark, folder, "graph_chunks"), "chunk_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that come out in more than one piece; only their keys are shuffled."""
    return splitting.pieces_of(table(spark, folder, "graph_chunks"), "chunk_id", "text").where("piece = 1").select("chunk_id").distinct()


def p7_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every distinct text of a chunk, joined without their overlaps, as a hash; and whether the bounds hold."""
    cut = table(spark, folder, "graph_chunks").where("chunk_id is not null and text is not null").select("chunk_id", splitting.cut_text(F.col("text")).alias("c"))
    joined = F.aggregate("c", F.lit(""), lambda done, p: F.concat(done, F.when(p["start"] == 0, p["text"]).otherwise(F.substr(p["text"], F.lit(101)))))
    bound = F.forall("c", lambda p: F.char_length(p["text"]) <= 1200)
    overlaps = F.forall(F.sequence(F.lit(1), F.size("c")), lambda i: (i == 1) | (F.right(F.get("c", i - 2)["text"], F.lit(1)) == F.substr(F.get("c", i - 1)["text"], F.lit(100), F.lit(1))))
    return cut.select("chunk_id", F.md5(joined).alias("joined"), (F.size("c") > 1).alias("split"), bound.alias("bounded"), overlaps.alias("overlapping")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    audit = table(spark, folder, "sentence_audit").select("sentence_id", F.col("evidence.text").alias("text"))
    parts = [
        ("candidate_evidence", sentences.sentence_units(table(spark, folder, "candidate_evidence"), "evidence_id", "text").withColumnRenamed("evidence_id", "record_id")),
        ("sentence_audit", sentences.sentence_units(audit, "sentence_id", "text").withColumnRenamed("sentence_id", "record_id")),
    ]
    a, b = [units.select(F.lit(name).alias("record_table"), "record_id", "start_offset", "end_offset") for name, units in parts]
    return a.unionByName(b)


def p2_cover(spark: SparkSession, folder: str) -> DataFrame:
    """The letters and digits of all sentence units of a record, over its distinct texts, and whether no unit is blank at an end."""
    texts = table(spark, folder, "candidate_evidence").where("evidence_id is not null and text is not null").select("evidence_id", "text").distinct()
    units = texts.select("evidence_id", "text", F.explode(sentences.spans_of("text")).alias("s"))
    unit = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    letters = F.char_length(F.regexp_replace(unit, r"[^\p{L}\p{N}]", ""))
    return units.groupBy("evidence_id").agg(F.sum(letters).alias("letters"), F.every((unit == F.trim(unit)) & (unit != "")).alias("trimmed"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    mentions = table(spark, folder, "concept_mentions").where("mention_id is not null")
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("canonical_name", "surface_text")])
    values = mentions.select(F.lit("concept_mentions").alias("record_table"), F.col("mention_id").alias("record_id"), F.explode(fields).alias("f"))
    targets = table(spark, folder, "graph_candidates").where("candidate_id is not null")
    values = values.select("record_table", "record_id", "f.field_name", "f.value").unionByName(
        targets.select(F.lit("graph_candidates").alias("record_table"), F.col("candidate_id").cast("string").alias("record_id"), F.lit("target_text").alias("field_name"), F.col("target_text").alias("value"))
    )
    found = lookalikes.meant_names(values, "value", table(spark, folder, "technical_concepts"), "canonical_name", "concept_id")
    return found.select("record_table", "field_name", "record_id", "concept_id").distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", "lang")


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that reveal no item."""
    return table(spark, folder, "documents").select("doc_id", "n_chars").join(p9_found(spark, folder), "doc_id", "left_anti")


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of 2,048 tokens and 64 segments; all tokens but a text's first bear loss."""
    counts = packing.token_counts(table(spark, folder, "documents"), "doc_id", "text", packing.Tokenizer(TOKENIZER, TOKEN_PATTERN))
    return packing.pack(counts.withColumn("loss", F.greatest(F.lit(0), F.col("tokens") - 1)), "doc_id", "tokens", "loss")


def p8_instruct(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as prompts, texts as answers: containers of 2,048 tokens, 64 segments and 1,792 loss-bearing tokens, those of the answers."""
    documents, tokenizer = table(spark, folder, "documents"), packing.Tokenizer(TOKENIZER, TOKEN_PATTERN)
    whole = documents.select("doc_id", F.concat_ws("\n", "title", "text").alias("both"), F.col("text").alias("answer"))
    return packing.pack(packing.token_counts(whole, "doc_id", ["both", "answer"], tokenizer), "doc_id", "both", "answer", 2048, 64, 1792)


def p8_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The packing of p8_pack with code points for tokens, judged for each document: its size, its parts, and whether all its containers keep the limits."""
    sizes = table(spark, folder, "documents").select("doc_id", F.char_length("text").alias("n"))
    packed = packing.pack(sizes.withColumn("loss", F.col("n") - F.floor(F.col("n") / 8)), "doc_id", "n", "loss", 2048, 64, 1900)
    used = packed.groupBy("container").agg(((F.sum("tokens") <= 2048) & (F.sum("loss_tokens") <= 1900) & (F.count("*") <= 64)).alias("kept"))
    each = packed.join(used, "container").groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("size"), F.sum("loss_tokens").alias("loss"), F.every("kept").alias("kept"), F.max("tokens").alias("largest"))
    return each.select("doc_id", "size", "loss", (F.col("parts") > 1).alias("split"), "kept", (F.col("largest") <= 2048).alias("within"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_report(p8_pack(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_spans(table(spark, folder, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "documents"), "doc_id", "text")


def p10_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The length of every text as its redacted form and the spans found tell it: placeholders out, spans back in."""
    texts = table(spark, folder, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    spans = pii.personal_spans(texts, "doc_id", "text")
    grown = spans.groupBy("doc_id").agg(F.sum(F.col("end_offset") - F.col("start_offset") - F.char_length("pii_type") - 2).alias("more"))
    return pii.redacted(texts, "doc_id", "text").join(grown, "doc_id", "left").select("doc_id", (F.char_length("text") + F.coalesce("more", F.lit(0))).alias("length"))


QUERIES = {"p10_lengths": p10_lengths, "p8_pack": p8_pack, "p8_report": p8_report, "p8_instruct": p8_instruct, "p8_chars": p8_chars, "p10_found": p10_found, "p10_redacted": p10_redacted, "p2_found": p2_found, "p2_cover": p2_cover, "p5_found": p5_found, "p9_found": p9_found, "p9_kept": p9_kept, "p4_found": p4_found, "p6_found": p6_found, "p6_terms": p6_terms, "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_joined": p7_joined}

ORACLE = {
    "p4_found": r"""
        WITH RECURSIVE d AS (
          SELECT least(feature_a, feature_b) AS u, greatest(feature_a, feature_b) AS v,
                 max(struct_pack(t := decided_at, m := upper(trim(decision)) = 'SAME')) AS l
          FROM pair_decisions WHERE feature_b IS NOT NULL AND feature_a IS NOT NULL AND feature_a <> feature_b GROUP BY ALL),
        e AS (SELECT u AS a, v AS b FROM d WHERE l.m UNION ALL SELECT v, u FROM d WHERE l.m),
        reach AS (SELECT DISTINCT a, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.a WHERE reach.r < e.b)
        SELECT min(r) AS group_key, a AS feature_key FROM reach GROUP BY a""",
    "p6_terms": r"""
        WITH c AS (SELECT cluster_id, any_value(canonical_text) AS canonical_text, any_value(document_count) AS document_count FROM feature_clusters GROUP BY cluster_id),
        w AS (SELECT cluster_id, document_count, unnest(regexp_extract_all(lower(canonical_text), '[\p{L}\p{N}]+')) AS term FROM c),
        p AS (SELECT cluster_id, term, count(*) AS n, any_value(document_count) AS document_count FROM w GROUP BY ALL),
        t AS (SELECT 'canonical_text' AS field_name, term, sum(n)::BIGINT AS occurrences, count(*) AS records, coalesce(sum(document_count), 0)::BIGINT AS weight FROM p GROUP BY term),
        a AS (SELECT assertion_id, min(relation_type) AS relation_type FROM annotations GROUP BY assertion_id),
        r AS (SELECT 'relation_type' AS field_name, relation_type AS term, count(*) AS occurrences, count(*) AS records, count(*) AS weight FROM a WHERE relation_type IS NOT NULL GROUP BY relation_type)
        SELECT t.*, CASE WHEN records > 0.1 * (SELECT count(*) FROM c) THEN 'common' WHEN weight <= 2 THEN 'rare' END AS mark FROM t
        UNION ALL SELECT r.*, CASE WHEN records > 0.1 * (SELECT count(*) FROM a) THEN 'common' WHEN records <= 2 THEN 'rare' END FROM r""",
    "p2_cover": r"""
        SELECT evidence_id, sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')))::BIGINT AS letters, true AS trimmed
        FROM (SELECT DISTINCT evidence_id, text FROM candidate_evidence WHERE evidence_id IS NOT NULL AND regexp_matches(text, '\S')) GROUP BY evidence_id""",
    "p10_lengths": "SELECT doc_id, length(text) AS length FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "p8_chars": r"""
        SELECT doc_id, length(text) AS size, length(text) - length(text) // 8 AS loss, length(text) > 2048 OR length(text) - length(text) // 8 > 1900 AS split, true AS kept, true AS within
        FROM documents WHERE doc_id IS NOT NULL""",
    "p7_joined": """
        SELECT DISTINCT chunk_id, md5(text) AS joined, length(text) > 1200 AS split, true AS bounded, true AS overlapping
        FROM graph_chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL""",
    "p7_found": "SELECT DISTINCT chunk_id FROM graph_chunks WHERE length(text) > 1200",
}
ORACLE["p6_found"] = f"SELECT field_name, term, mark FROM ({ORACLE['p6_terms']}) WHERE mark IS NOT NULL"
