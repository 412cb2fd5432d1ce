"""Side-by-side run of a registered query and its SQL."""
from __future__ import annotations

import math
import os
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

STRICT = bool(os.environ.get("STRICT_FLOATS"))
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value: object) -> str:
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, (bool,)) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        value = float(value)
        if math.isnan(value):
            return "NULL"
        return repr(value if STRICT else round(value, 6) + 0.0)
    if type(value).__name__.startswith(("int", "uint")):
        return str(int(value))
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat() if value.tzinfo is None else value.tz_convert("UTC").tz_localize(None).isoformat()
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(spark: SparkSession, con, sf: str, fn, sql: str | None, clock: dict | None = None) -> str | None:
    """NULL when equal, else what differs."""
    start = time.time()
    got = fn(spark, sf).toPandas()
    if clock is not None:
        clock["spark"] = time.time() - start
    if sql is None:
        return None if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; spark {a[:2]} sql {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"values {x} != {y}"
    bad = [c for c in got.columns if _kind(got[c]) != _kind(want[c])]
    return f"types differ in {[(c, got[c].dtype, want[c].dtype) for c in bad]}" if bad else None


def _kind(series: pd.Series) -> str:
    name = str(series.dtype).lower()
    return "float" if name.startswith("float") else "int" if name.startswith(("int", "uint")) else "bool" if name.startswith("bool") else "other"
