"""Runs a query's SQL in DuckDB and compares it with the query, order aside."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str, datetime.date)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.10g}")
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql: str) -> None:
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, found.fetchall())
