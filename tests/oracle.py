"""Compares a DataFrame with DuckDB's answer, rows in any order, doubles to six digits."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def check(df, sql, sf, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=repr)
    assert got == want
