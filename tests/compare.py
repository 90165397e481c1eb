"""Run queries in Spark and their SQL in DuckDB and compare rows, columns, types and values."""

from __future__ import annotations

import glob
import os
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple(str(v) for v in r)
    )


def compare(spark, con, sf_dir, fn, sql) -> tuple[bool, str, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    pairs = [p for p in ("CartesianProduct", "BroadcastNestedLoopJoin") if p in plan]
    if pairs:
        return False, f"all pairs in the plan: {pairs}", took
    if sql is None:
        return len(mine[1]) > 0, f"rows only: {len(mine[1])}", took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} != {theirs[0]}", took
    if len(mine[1]) != len(theirs[1]):
        return False, f"rows {len(mine[1])} != {len(theirs[1])}", took
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(mine[1])} differ, e.g. {bad[0]}", took
    kinds = [
        (n, type(a).__name__, type(b).__name__)
        for n, a, b in zip(mine[0], mine[1][0] if mine[1] else (), theirs[1][0] if theirs[1] else ())
        if type(a) is not type(b)
    ]
    if kinds:
        return False, f"types {kinds}", took
    return True, f"{len(mine[1])} rows", took


__all__ = ["TABLES", "compare", "duck", "pd"]
