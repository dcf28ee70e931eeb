"""Queries of the general problems: orphan references and quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.io import table
from skein.operators import orphans, units


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    annotations, evidence = table(spark, folder, "annotations"), table(spark, folder, "candidate_evidence")
    mentions, chunks = table(spark, folder, "concept_mentions"), table(spark, folder, "graph_chunks")
    a = orphans.orphans_of_table(annotations, "annotations", "assertion_id", [("head_mention_id", mentions, "mention_id"), ("tail_mention_id", mentions, "mention_id")])
    b = orphans.orphans_of_table(evidence, "candidate_evidence", "evidence_id", [("chunk_id", chunks, "chunk_id")])
    return a.unionByName(b)


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(p1_found(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.canonical_quantities(table(spark, folder, "annotations"), "assertion_id", "raw_value", "unit", "raw_text", "qualifier_type")


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Assertions without a value in a canonical unit, by reason."""
    judged = units.judged_quantities(table(spark, folder, "annotations"), "assertion_id", "raw_value", "unit", "raw_text", "qualifier_type")
    return judged.where("reason is not null").groupBy("reason").agg(F.count_distinct("assertion_id").alias("assertions"))


QUERIES = {"p3_reasons": p3_reasons, "p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found}

_P1 = r"""
WITH r AS (
 SELECT 'annotations' AS record_table, f AS field_name, assertion_id AS record_id, k, received_at, 'm' AS target FROM (
   SELECT assertion_id, received_at, unnest(['head_mention_id','tail_mention_id']) AS f, unnest([head_mention_id, tail_mention_id]) AS k FROM annotations)
 UNION ALL SELECT 'candidate_evidence','chunk_id',evidence_id,chunk_id,received_at,'c' FROM candidate_evidence),
 j AS (SELECT record_table, field_name, record_id, target, right(regexp_replace(lower(k),'[-{}\s]','','g'),32) AS k, min(received_at) OVER (PARTITION BY record_table, record_id) AS t FROM r),
 p AS (SELECT 'm' AS target, replace(lower(mention_id),'-','') AS k, min(received_at) AS seen, min(deleted_at) AS gone FROM concept_mentions GROUP BY ALL
 UNION ALL SELECT 'c', replace(lower(chunk_id),'-',''), min(received_at), min(deleted_at) FROM graph_chunks GROUP BY ALL)
SELECT DISTINCT record_table, field_name, record_id, strftime(t,'%Y-%m') AS period FROM j LEFT JOIN p USING (target, k)
WHERE j.k IS NOT NULL AND NOT coalesce(p.seen <= t AND (p.gone IS NULL OR p.gone > t), false)
"""



def _p3() -> str:
    """The same parsing in SQL, over integers of 12 decimals; the conversions are listed as values."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    blanks = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000]))
    values = ", ".join(f"({quote(s)}, {str(f).lower()}, {quote(d)}, {m}::HUGEINT, {b}::HUGEINT, {q}::HUGEINT)" for s, f, d, m, b, q in units.conversion_rows())
    words = ", ".join(f"({quote(w)}, {quote(str(n))})" for w, n in units.NUMBER_WORDS.items())
    any_word = "|".join(sorted(units.NUMBER_WORDS, key=lambda w: -len(w)))

    def plain(x: str) -> str:
        x = f"replace(replace({x}, '℃', '°C'), '℉', '°F')"
        x = rf"regexp_replace({x}, '10\s*([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹])', '10^\1', 'g')"
        x = f"translate({x}, {quote('⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−' + blanks + 'μΩÅK％’')}, {quote('0123456789-+-' + ' ' * len(blanks) + 'µΩÅK%' + chr(39))})"
        return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"

    pattern = quote(units.QUANTITY)
    spelled = lambda t: rf"""replace(translate(regexp_extract({t}, {pattern}, 2), ' ''+', ''), ',', '.') || coalesce('e' || nullif(regexp_extract(regexp_extract({t}, {pattern}, 3), '([-+]?\d+)$', 1), ''), '')"""
    number = lambda t: f"(TRY_CAST({spelled(t)} AS DECIMAL(38, 12)) * 1000000000000::HUGEINT)::HUGEINT"
    unit = lambda t: f"trim(regexp_extract({t}, {pattern}, 4))"
    return rf"""
    WITH k(spelling, folded, dimension, multiplier, plus, divisor) AS (VALUES {values}), w(word, digits) AS (VALUES {words}),
    a AS (SELECT DISTINCT assertion_id, raw_text, raw_value, unit, qualifier_type FROM annotations WHERE assertion_id IS NOT NULL),
    b AS (SELECT assertion_id, upper(trim(qualifier_type)) AS q, {plain("raw_text")} AS t0, {plain("raw_value")} AS v, {plain("unit")} AS u FROM a),
    c AS (SELECT b.*, row_number() OVER () AS row, CASE WHEN NOT regexp_matches(t0, '\d') AND w.digits IS NOT NULL THEN w.digits || regexp_extract(t0, '(?i)(?:^|[\s~≈:])(?:{any_word})(\s.*)$', 1) ELSE t0 END AS t
      FROM b LEFT JOIN w ON lower(regexp_extract(t0, '(?i)(?:^|[\s~≈:])({any_word})\s', 1)) = w.word),
    n AS (SELECT row, assertion_id, q, u, {number("t")} AS tn, {unit("t")} AS tu, {number("v")} AS vn, {unit("v")} AS vu FROM c),
    o AS (SELECT row, assertion_id, q, unnest([{{'r': 0, 'n': tn, 'name': tu}}, {{'r': 1, 'n': vn, 'name': vu}}, {{'r': 2, 'n': CASE WHEN vu = '' THEN vn END, 'name': u}}, {{'r': 3, 'n': CASE WHEN tu = '' THEN tn END, 'name': u}}]) AS x FROM n),
    m AS (SELECT o.row, o.assertion_id, o.q, x.r, x.n, k.* FROM o JOIN k ON (NOT k.folded AND x.name = k.spelling) OR (k.folded AND lower(x.name) = k.spelling AND x.name NOT IN (SELECT spelling FROM k WHERE NOT folded)) WHERE x.n IS NOT NULL),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY row ORDER BY r) = 1),
    g AS (SELECT n.assertion_id, f.dimension, ((f.n * f.multiplier + f.plus * 1000000000000 + f.divisor * 500000000000) // (f.divisor * 1000000000000))::BIGINT AS base_value,
      CASE WHEN tn IS NULL AND vn IS NULL THEN 'no single number' WHEN f.row IS NULL THEN 'unknown unit' WHEN coalesce(f.q = 'HUMIDITY' AND f.spelling IN ('%', 'percent', 'per cent', 'prozent'), false) THEN 'other percentage' END AS reason
      FROM n LEFT JOIN f USING (row))"""


ORACLE = {
    "p3_found": _p3() + " SELECT DISTINCT assertion_id, dimension, base_value FROM g WHERE reason IS NULL",
    "p3_reasons": _p3() + " SELECT reason, count(DISTINCT assertion_id) AS assertions FROM g WHERE reason IS NOT NULL GROUP BY reason",
    "p1_found": _P1,
    "p1_report": f"SELECT record_table, field_name, period, count(*) AS orphans FROM ({_P1}) GROUP BY ALL",
}
