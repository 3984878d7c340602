"""Compares a Spark result with DuckDB's over the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4; SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x) or x is pd.NaT:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x


def kind(dtype: str) -> str:
    """Coarse type: what a hash of values would tell apart."""
    d = dtype.lower()
    if d in ("bigint", "long", "int", "integer", "smallint", "hugeint"):
        return {"hugeint": "hugeint"}.get(d, "long" if d in ("bigint", "long") else "int")
    return {"varchar": "string", "string": "string", "double": "double", "float": "float", "boolean": "boolean"}.get(d, d)


def differences(df, con, sql: str) -> list[str]:
    want = con.execute(sql)
    names, kinds = [d[0] for d in want.description], [kind(str(d[1])) for d in want.description]
    rows = want.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    spark_kinds = dict(df.dtypes)
    out += [f"type of {n}: {spark_kinds[n]} and {k}" for n, k in zip(names, kinds) if kind(spark_kinds[n]) != k]
    order = sorted(names)
    a = sorted((tuple(_cell(r[c]) for c in order) for r in df.collect()), key=str)
    b = sorted((tuple(_cell(r[names.index(c)]) for c in order) for r in rows), key=str)
    if len(a) != len(b):
        out.append(f"rows {len(a)} and {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, as {bad[0]} ({order})")
    return out
