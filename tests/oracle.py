"""Runs a registered query and its DuckDB SQL over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads = 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    expected = rows_of(names, got.fetchall())
    assert sorted(names) == sorted(df.columns)
    actual = rows_of(df.columns, df.collect())
    assert len(actual) == len(expected), (len(actual), len(expected))
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    assert not wrong, (len(wrong), wrong[:3])
