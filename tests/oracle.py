"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows(columns: list[str], data: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What sets the query's rows apart from the SQL's; empty if nothing does."""
    want = db.sql(sql)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    if sorted(df.columns) != sorted(want.columns):
        return [f"columns {sorted(df.columns)} and {sorted(want.columns)}"]
    if not a:
        return ["no rows"]
    return [f"{len(a)} and {len(b)} rows", *[f"{x}  <>  {y}" for x, y in zip(a, b) if x != y][:4]] if a != b else []
