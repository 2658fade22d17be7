"""Spark's rows against DuckDB's, in any order: the same columns and, but for the types' names, the same values."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """Integers and decimals exactly, whatever their types' scales; doubles to 12 digits, zero without a sign."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int | Decimal):
        return f"{Decimal(x).normalize() + 0:f}"
    if isinstance(x, float):
        return None if math.isnan(x) else ("double", f"{x + 0.0:.12g}")
    return str(x) if isinstance(x, datetime.date | datetime.datetime) else x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir: str, sql: str) -> tuple[list[str], list]:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = c.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def differences(df, sf_dir: str, sql: str) -> str | None:
    names, data = duck(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, data)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows, first {odd}"
    return None
