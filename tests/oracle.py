"""Holds a query against its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


def same(df, c, sql):
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    want = c.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    return len(got)
