"""Comparison of Spark results with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, Decimal)):
        value = round(float(value), 6)
        return str(int(value)) if math.isfinite(value) and value.is_integer() else repr(value)
    return str(value)


def rows(names, records):
    """Rows as texts, columns by name, in any order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def same(df, con, sql: str) -> None:
    got = rows(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, found.fetchall())
