"""Compares a registered query with its SQL in DuckDB: names, row count and values in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def difference(spark, sf_dir: str, query, sql: str, tolerance: float = 0.0) -> str:
    """Empty if they agree."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = connect(sf_dir).sql(sql)
    names, want = list(rel.columns), rows(list(rel.columns), rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance for x, y in zip(a, b)):
            return f"{a} and {b}"
    return ""
