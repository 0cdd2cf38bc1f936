"""Comparing a query with its SQL in DuckDB, whatever the order of rows."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd


def plain(x):
    if isinstance(x, np.ndarray):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 9)
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(x))
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False, name=None))


def expected(sql, folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con.sql(sql).df()
