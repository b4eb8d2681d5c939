"""Compares a query's rows with those of its SQL."""

import glob
import os

import duckdb


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(_plain, value)) if isinstance(value, list) else value


def assert_same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr(tuple(_plain(r[names.index(c)]) for c in df.columns)) for r in found.fetchall())
    have = sorted(repr(tuple(_plain(x) for x in r)) for r in df.collect())
    assert have == want
