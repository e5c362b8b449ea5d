"""Holding a query against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if isinstance(v, str) else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


def same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    cursor = c.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == expected
