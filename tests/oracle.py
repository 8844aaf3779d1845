"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


def same(spark_df, con, sql):
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
