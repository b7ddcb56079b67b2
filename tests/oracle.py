"""Comparison of a Spark result with DuckDB's answer on the same tables, column by column, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

DATA = os.environ.get("TILESPARK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def key(row):
    return [(x is not None, str(type(x)), x) if not isinstance(x, (int, float)) or isinstance(x, bool) else (True, "n", x) for x in row]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(([plain(r[k]) for k in order] for r in rows), key=key)


def expected(sql: str, data: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def got(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
