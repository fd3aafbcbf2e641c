"""Runs a query's SQL in DuckDB and compares both results as sorted rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(frame, columns):
    def cell(v):
        if isinstance(v, float) and v != v or v is None or v is pd.NaT or v is pd.NA:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


def same(spark_frame, sql, con):
    got, want = spark_frame.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(want, columns)
