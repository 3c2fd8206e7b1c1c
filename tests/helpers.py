"""Comparison of a query with its DuckDB form."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def cell(v: object) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (len(a), len(b), sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
