"""Compares a query with its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    return f"{float(v) + 0.0:.6f}" if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=repr)


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def same(spark, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
