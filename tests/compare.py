"""Rows of a Spark query beside those of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(glob.glob(f"{DATA}/*.parquet")):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


def check(spark, query, sql, con):
    mine, theirs = query(spark, DATA).toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
