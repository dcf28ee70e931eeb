"""Rows of a query against rows of its SQL."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, (int, float)):
        return round(float(x), 6) + 0.0
    return str(x)


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)
