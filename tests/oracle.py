"""Compares a query with its SQL in DuckDB over the tables of a folder."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(value(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 9)
    return str(v)


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in data)


def same(spark, con, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    want = con.execute(sql).df()
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(list(want.columns), list(want.itertuples(index=False, name=None)))
