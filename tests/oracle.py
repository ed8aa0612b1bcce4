"""Runs a query and its SQL side by side."""

import os

import duckdb
import pandas as pd


def connection(directory: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(directory):
        con.execute(f"create view {f[:-8]} as select * from '{directory}/{f}'")
    return con


def _text(v) -> str:
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "null"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    try:
        return repr(round(float(v), 6)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_text(v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark, directory: str, query, sql: str) -> None:
    got, want = query(spark, directory).toPandas(), connection(directory).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
