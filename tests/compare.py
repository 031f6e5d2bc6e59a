"""Compares a query's rows with its SQL's, whatever their order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, bytearray):
        return bytes(x)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(df, con, sql: str) -> None:
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    want = rows_of(columns, got.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == want
