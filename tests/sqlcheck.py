"""Compares a query's rows with its SQL over the same tables."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(folder: str = SF):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(cell(v) for v in r)) for r in df.itertuples(index=False, name=None))
