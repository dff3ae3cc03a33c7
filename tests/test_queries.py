"""Every engine query against its SQL, on the smallest tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

from barwright.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0  # no rounding: a last digit that differs is a failure
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(norm(r[c]) for c in columns) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    names = [r[0] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()]
    assert sorted(names) == columns
    want = ordered([tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in con.execute(ORACLES[name]).fetchall()])
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        for c, x, y in zip(columns, g, w):
            same = x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
            assert same, (c, g, w)
