"""Order-free comparison of a Spark result with DuckDB's."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "NULL"
        return str(bool(v)) if isinstance(v, bool) else repr(round(float(v), 6)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)].copy()
    for col in df.columns:
        df[col] = df[col].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)
