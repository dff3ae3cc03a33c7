"""Run a query and its SQL side by side."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows_of_sql(sf_dir, sql):
    con = connect(sf_dir)
    names = [r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    return sorted(([dict(zip(names, r)) for r in con.execute(sql).fetchall()]), key=lambda r: str(sorted(r.items())))


def rows_of_query(spark, sf_dir, query):
    return sorted((r.asDict() for r in query(spark, sf_dir).collect()), key=lambda r: str(sorted(r.items())))


def same(spark, sf_dir, query, sql):
    got, want = rows_of_query(spark, sf_dir, query), rows_of_sql(sf_dir, sql)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
