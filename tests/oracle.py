"""Rows of a query and of its SQL, in one comparable form."""

import os

import duckdb
import pandas as pd


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return comparable(con.execute(sql).fetchdf())


def comparable(df: pd.DataFrame):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df[cols].map(cell).values))
