"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(path: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{path}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def both(df, con, sql: str):
    """Sorted rows of the query and of its SQL, columns by name."""
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    r = con.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    return ours, sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
