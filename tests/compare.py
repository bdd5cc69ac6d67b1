"""Compare query results with DuckDB over one folder of tables."""

import math
import os
from decimal import Decimal

import duckdb

DATA = "/root/testdata/sf0.001"


def views(folder=DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) if math.isfinite(v) else str(v)
    return v


def rows_of(df, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def check(spark, con, query, sql, folder=DATA):
    df, want = query(spark, folder), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert rows_of(df, names) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
