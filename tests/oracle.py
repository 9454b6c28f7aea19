"""Runs a query's SQL in DuckDB over the same tables and compares the rows."""

import glob
import os

import duckdb


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def same(spark_df, sql, sf_dir, digits=9):
    columns, want = sql_rows(sql, sf_dir)
    names = sorted(columns)
    assert sorted(spark_df.columns) == names
    norm = lambda v: round(v, digits) if isinstance(v, float) else v
    got = sorted(repr(tuple(norm(r[n]) for n in names)) for r in spark_df.collect())
    exp = sorted(repr(tuple(norm(r[columns.index(n)]) for n in names)) for r in want)
    assert got == exp
    return len(got)
