"""Compares a query with its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return x


def compare(spark, query, sql: str, folder: str) -> tuple[list, list]:
    """(rows of the query, rows of the SQL), both with columns by name and in order."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    ours = sorted(repr(_plain(tuple(r))) for r in frame.select(*columns).collect())
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(_plain(tuple(r[i] for i in at))) for r in result.fetchall())
    return ours, theirs
