"""A Spark result against DuckDB's on the same tables: names, row counts and values, in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if v is None or isinstance(v, (bool, int)):
        return v
    return str(v)


def same_as_sql(df, sql: str, sf_dir: str) -> None:
    duck = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    expected = duck.sql(sql)
    names = sorted(expected.columns)
    assert sorted(df.columns) == names
    at = [expected.columns.index(c) for c in names]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    ours = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    assert ours == theirs
