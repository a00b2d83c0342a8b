"""Holds queries against their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    show = lambda x: "null" if x is None or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    df = df[sorted(df.columns)]
    df = df.astype(object)
    return sorted(tuple(("%d" % x if isinstance(x, float) and x == int(x) else show(x)) if not pd.isna(x) else "null" for x in r) for r in df.itertuples(index=False))


def differs(spark, query, sql: str, sf_dir: str) -> str:
    got, want = query(spark, sf_dir).toPandas(), views(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        return f"{len(a)} and {len(b)} rows; first of difference: {sorted(set(a) - set(b))[:1]} {sorted(set(b) - set(a))[:1]}"
    return "" if len(a) else "no rows"
