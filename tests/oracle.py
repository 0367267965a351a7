"""Compares a query with its SQL in DuckDB: column names, row counts and values, in any order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(df, sql, sf_dir):
    """Empty if both give the same; else what differs."""
    got = connection(sf_dir).execute(sql)
    columns = [d[0] for d in got.description]
    want = rows_of(columns, got.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(have) != len(want):
        return f"rows {len(have)} and {len(want)}"
    odd = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(odd)} rows differ, as {odd[:2]}" if odd else ""
