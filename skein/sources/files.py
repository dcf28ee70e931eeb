"""Files: CSV with a byte-order mark, JSON lines with last-wins keys, logs, hash-checked snapshots, reports and event frames."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.latest import newest


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte-order mark in front of the first name is ignored because names come from the schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, encoding="UTF-8", multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_keyed_lines(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON lines of which the last line of a key counts. Lines that aren't JSON are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "_file", "_block", "_line").where("r is not null").select("r.*", "_file", "_block", "_line")
    return newest(rows.where(" and ".join(f"{k} is not null" for k in keys)), keys, F.col("_file"), F.col("_block"), F.col("_line")).drop("_file", "_block", "_line")


def read_log(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """at, status, duration_ms, line of log lines that begin with an ISO time within [start, end)."""
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_extract("value", r"^\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1), "T", " "))
    status = F.regexp_extract("value", r"\b(?:status[=: ]|HTTP/\d\.\d\"? )(\d{3})\b", 1)
    took = F.regexp_extract("value", r"\b(\d+(?:\.\d+)?) ?ms\b", 1)
    lines = spark.read.text(path).select(at.alias("at"), F.when(status != "", status.cast("int")).alias("status"), F.when(took != "", took.cast("double")).alias("duration_ms"), F.col("value").alias("line"))
    return lines.where((F.col("at") >= F.lit(start).cast("timestamp")) & (F.col("at") < F.lit(end).cast("timestamp")))


def write_snapshot(rows: list[dict], path: str) -> str:
    """Rows as canonical JSON beside their SHA-256; written aside and renamed. For small results on the driver's disk."""
    body = json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    digest = hashlib.sha256(body).hexdigest()
    for name, content in ((f"{path}.sha256", digest.encode()), (path, body)):
        aside = Path(f"{name}.part")
        aside.write_bytes(content)
        aside.replace(name)
    return digest


def load_snapshot(path: str) -> list[dict]:
    body = Path(path).read_bytes()
    if hashlib.sha256(body).hexdigest() != Path(f"{path}.sha256").read_text():
        raise ValueError("the snapshot doesn't match its hash")
    return json.loads(body)


def export_lines(parents: DataFrame, children: DataFrame, key: str, order: list[str], path: str) -> None:
    """One JSON line for each parent with its children in order. A parent's children are bounded (chunks of a revision)."""
    fields = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in children.columns if c not in [key, *order]])
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("children"))
    rows = parents.join(nested, key, "left")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("errorifexists").text(path)


def report_markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A table of a small result; at most `most` rows, and a line that says so if there are more."""
    got = rows.limit(most + 1).collect()
    cell = lambda v: html.escape("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in got[:most]]
    return "\n".join([*lines, *(["", f"More than {most} rows."] if len(got) > most else [])]) + "\n"


def event_frame(sequence: int, kind: str, payload: dict) -> str:
    """A server-sent event."""
    body = json.dumps(payload, separators=(",", ":"), ensure_ascii=False)
    return f"id: {sequence}\nevent: {kind}\ndata: {body}\n\n"


def event_frames(lines: Iterable[str]) -> Iterator[dict]:
    """Server-sent events from lines of a stream; comments are skipped, data lines of one event are joined."""
    event: dict = {}
    data: list[str] = []
    for raw in lines:
        line = raw.rstrip("\r\n")
        if not line:
            if data:
                yield {"id": int(event["id"]) if "id" in event else None, "event": event.get("event", "message"), "data": json.loads("\n".join(data))}
            event, data = {}, []
        elif not line.startswith(":"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            else:
                event[name] = value
