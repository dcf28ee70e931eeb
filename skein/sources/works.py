"""Scientific works as JSON: typed records with a status for each field, and normalized documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import words_by_position

#: Only what is used is read; the rest of a work is skipped by the parser.
WORK_SCHEMA = """id string, title string, display_name string, abstract_inverted_index map<string, array<int>>, publication_date string, updated_date string, doi string,
    primary_location struct<landing_page_url: string>, language string, authorships array<struct<author: struct<id: string, display_name: string>>>,
    topics array<struct<id: string, display_name: string, score: double>>, referenced_works array<string>, cited_by_count long"""


def _identifier(value: Column, letter: str) -> Column:
    last = F.upper(F.substring_index(F.trim(value), "/", -1))
    return F.when(last.rlike(f"^{letter}[0-9]+$"), last)


def _text(value: Column) -> Column:
    v = F.trim(value)
    return F.when(v != "", v)


def _web(value: Column) -> Column:
    return F.when(F.try_parse_url(value, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(value, F.lit("HOST")).isNotNull(), value)


def read_works(spark: SparkSession, path: str, wrapped: bool = False, lines: bool = False) -> DataFrame:
    """Raw works: a JSON object for each file, or (lines) for each line; wrapped: objects with a list `results`."""
    if wrapped:
        pages = spark.read.schema(f"results array<struct<{_fields()}>>").option("multiLine", "true").json(path)
        return pages.select(F.explode("results").alias("w")).select("w.*")
    return spark.read.schema(WORK_SCHEMA).option("multiLine", str(not lines).lower()).json(path)


def _fields() -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(WORK_SCHEMA))


def parse_works(raw: DataFrame) -> DataFrame:
    """external_id, title, abstract, publication_date, updated_at, doi, landing_page_url, language, authors, topics,
    referenced_work_ids, cited_by_count, field_status. Works without an id are left out."""
    doi = _web(F.col("doi"))
    doi = F.when(F.try_parse_url(doi, F.lit("HOST")).isin("doi.org", "dx.doi.org"), doi)
    authors = F.transform(F.filter("authorships", lambda a: a["author"].isNotNull()), lambda a: F.struct(_identifier(a["author"]["id"], "A").alias("id"), _text(a["author"]["display_name"]).alias("name")))
    topics = F.transform("topics", lambda t: F.struct(_identifier(t["id"], "T").alias("id"), _text(t["display_name"]).alias("name"), F.when(~F.isnan(t["score"]), t["score"]).alias("score")))
    refs = F.filter(F.transform("referenced_works", lambda r: _identifier(r, "W")), lambda r: r.isNotNull())
    out = raw.select(
        _identifier(F.col("id"), "W").alias("external_id"),
        F.coalesce(_text(F.col("title")), _text(F.col("display_name"))).alias("title"),
        words_by_position(F.col("abstract_inverted_index")).alias("abstract"),
        F.try_to_date("publication_date", "yyyy-MM-dd").alias("publication_date"),
        F.coalesce(F.try_to_timestamp("updated_date"), F.try_to_timestamp("updated_date", F.lit("yyyy-MM-dd"))).alias("updated_at"),
        doi.alias("doi"),
        _web(F.col("primary_location.landing_page_url")).alias("landing_page_url"),
        _text(F.col("language")).alias("language"),
        authors.alias("authors"),
        topics.alias("topics"),
        refs.alias("referenced_work_ids"),
        F.when(F.col("cited_by_count") >= 0, F.col("cited_by_count")).alias("cited_by_count"),
    ).where("external_id is not null")
    named = ["title", "abstract", "publication_date", "updated_at", "doi", "authors", "topics", "referenced_work_ids", "cited_by_count"]
    return out.withColumn("field_status", field_status(named))


def field_status(columns: list[str]) -> Column:
    pairs = [x for c in columns for x in (F.lit(c), F.when(F.col(c).isNull(), "missing").otherwise("available"))]
    return F.create_map(*pairs)


def normalized_works(works: DataFrame) -> DataFrame:
    """source, external_id, canonical_url, kind, title, publication_date, sections, metadata (JSON)."""
    sections = F.filter(F.array(F.struct(F.lit("abstract").alias("name"), F.col("abstract").alias("text"), F.col("language").alias("language"))), lambda s: s["text"].isNotNull())
    metadata = F.to_json(F.struct("doi", "landing_page_url", "authors", "topics", "referenced_work_ids", "cited_by_count", "field_status"))
    return works.select(F.lit("openalex").alias("source"), "external_id", F.concat(F.lit("https://openalex.org/"), "external_id").alias("canonical_url"), F.lit("article").alias("kind"), F.coalesce("title", "external_id").alias("title"), "publication_date", sections.alias("sections"), metadata.alias("metadata"))


def eligible(documents: DataFrame, least: int = 80) -> DataFrame:
    """Documents with a title and enough text in their sections."""
    size = F.aggregate("sections", F.lit(0), lambda n, s: n + F.char_length(F.trim(s["text"])))
    return documents.where((F.trim("title") != "") & (size >= least))
