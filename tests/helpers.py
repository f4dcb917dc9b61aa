"""Small frames for the operator tests."""

from __future__ import annotations

import datetime as dt

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings cards targets price_snapshot price_quote sentiment alert_ledger fx_rate rarity_vocabulary source_weights".split()


def t(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def duck(root: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS FROM '{root}/{n}.parquet'")
    return c


def cell(v):
    """A value as both engines give it."""
    if v is None or v != v:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)[:26] if hasattr(v, "year") else v


def table_of(columns: list[str], data) -> dict:
    """Rows with their columns in order, counted."""
    from collections import Counter

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)
