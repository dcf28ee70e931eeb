"""Patent documents as namespaced XML: safe parsing of whole files in the tasks, typed records, full text."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import xml.parsers.expat as expat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are refused.
MAX_BYTES = 2_000_000

PATENT_SCHEMA = "external_id string, country string, publication_number string, kind string, title string, abstract string, publication_date date, claims string, description string, problem string, path string"


class UnsafeXml(ValueError):
    """A file that is too large, declares a document type or entities, or isn't XML."""


def _refuse(*_) -> None:
    raise UnsafeXml("unsafe_xml")


def tree(content: bytes) -> ET.Element:
    """The root of a document. The parser itself refuses document types and entities where they are declared."""
    if len(content) > MAX_BYTES:
        _refuse()
    builder, parser = ET.TreeBuilder(), expat.ParserCreate(namespace_separator="}")
    qualified = lambda name: "{" + name if "}" in name else name
    parser.buffer_text = True
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = _refuse
    parser.StartElementHandler = lambda name, attributes: builder.start(qualified(name), {qualified(k): v for k, v in attributes.items()})
    parser.EndElementHandler = lambda name: builder.end(qualified(name))
    parser.CharacterDataHandler = builder.data
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise UnsafeXml("invalid_xml") from e
    return builder.close()


def named(node: ET.Element, name: str) -> list[ET.Element]:
    """Descendants by local name, whatever their namespace, the node itself included."""
    return [n for n in node.iter() if isinstance(n.tag, str) and n.tag.rpartition("}")[2] == name]


def text_of(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _preferred(nodes: list[ET.Element]) -> str | None:
    """The first non-empty text, English first."""
    english = [n for n in nodes if n.get("lang", "").lower() == "en"]
    return next((t for n in [*english, *nodes] if (t := text_of(n))), None)


def paragraphs(root: ET.Element, part: str, unit: str) -> str | None:
    """The paragraphs of a part of the full text, a line each."""
    lines = [text_of(u) for n in named(root, part) for u in (named(n, unit) or [n])]
    return "\n".join(t for t in lines if t) or None


def parse_patents(content: bytes) -> list[dict]:
    """A record for each document with a complete publication number; of repeated numbers the last counts."""
    root = tree(content)
    out: dict[str, dict] = {}
    for node in named(root, "exchange-document"):
        ids = [d for r in named(node, "publication-reference") for d in named(r, "document-id")]
        docdb = next((d for d in ids if d.get("document-id-type") == "docdb"), None)
        inner = lambda name: next((text_of(x) for x in named(docdb, name)), None) if docdb is not None else None
        number = [(node.get(k) or inner(k) or "").upper() for k in ("country", "doc-number", "kind")]
        if not re.fullmatch(r"[A-Z]{2}\.[A-Z0-9]+\.[A-Z][0-9]?", ".".join(number)):
            continue
        dates = [t for d in ids for x in named(d, "date") if re.fullmatch(r"\d{8}", t := text_of(x))]
        day = pd.to_datetime(dates[0], format="%Y%m%d", errors="coerce") if dates else None
        out[".".join(number)] = {
            "external_id": ".".join(number), "country": number[0], "publication_number": number[1], "kind": number[2],
            "title": _preferred(named(node, "invention-title")), "abstract": _preferred(named(node, "abstract")),
            "publication_date": None if day is None or pd.isna(day) else day.date(),
            "claims": paragraphs(node, "claims", "claim"), "description": paragraphs(node, "description", "p"),
        }
    return list(out.values())


def read_patents(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files under a path; see parsed_patents."""
    return parsed_patents(spark.read.format("binaryFile").load(path).select("path", "content"))


def parsed_patents(files: DataFrame) -> DataFrame:
    """Records of files (path, content); a refused file gives one row that names the problem."""
    columns = [c.split()[0] for c in PATENT_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [r | {"path": name} for r in parse_patents(bytes(content))]
                except UnsafeXml as e:
                    rows.append({"problem": str(e), "path": name})
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return files.mapInPandas(parse, PATENT_SCHEMA)


def normalized_patents(patents: DataFrame) -> DataFrame:
    """source, external_id, canonical_url, kind, title, publication_date, sections, metadata (JSON)."""
    ok = patents.where("problem is null")
    section = lambda name: F.struct(F.lit(name).alias("name"), F.col(name).alias("text"), F.lit(None).cast("string").alias("language"))
    sections = F.filter(F.array(section("abstract"), section("claims"), section("description")), lambda s: s["text"].isNotNull())
    url = F.concat(F.lit("https://worldwide.espacenet.com/patent/search?q=pn%3D"), "country", "publication_number", "kind")
    metadata = F.to_json(F.struct("country", "publication_number", F.col("kind").alias("kind_code")))
    return ok.select(F.lit("epo_ops").alias("source"), "external_id", url.alias("canonical_url"), F.lit("patent").alias("kind"), F.coalesce("title", "external_id").alias("title"), "publication_date", sections.alias("sections"), metadata.alias("metadata"))
