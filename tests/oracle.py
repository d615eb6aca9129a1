"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import numpy as np

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def plain(v):
    """A value as both engines would show it: floats to six digits, NaN as missing."""
    if v is None or isinstance(v, float | np.floating) and math.isnan(v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float | np.floating | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return str(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in (x.asDict(True) for x in df.collect())), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    held = [d[0] for d in got.description]
    names = sorted(held)
    at = [held.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
