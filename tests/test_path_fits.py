"""Paths of the last rows in arrays against the fit of each path by itself."""

import random

import pytest
from pyspark.sql import functions as F

from barwright.operators.fits import path_fits, trailing_path_fits

NAMES = ("points", "slope", "concavity", "exponent", "r2")


@pytest.mark.parametrize("batch", [4, 10_000])
def test_paths_of_the_last_rows(spark, batch):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([-3, 1, 2, 5, 0, None]), rng.choice([1, 2, 9, None]), 50 + 3.0 * i**0.5 + rng.random()) for k, n in (("a", 40), ("b", 3), ("c", 1), ("d", 12), (None, 15)) for i in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.k, r.i): r for r in trailing_path_fits(spark.createDataFrame(rows, "k string, i int, f long, s long, v double"), "k", ["i"], "f", "s", "v", 6).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    paths = {}
    for k, i, *_ in rows:
        last = [r for r in rows if r[0] == k and r[1] <= i][-6:]
        flow = sum(r[2] or 0 for r in last[1:])
        if flow:
            sign, x, path = (1 if flow > 0 else -1), 0, []
            for j, r in enumerate(last):
                x += (r[2] or 0) if j else 0
                path.append({"x": float(sign * x), "y": sign * (r[4] - last[0][4])})
            paths[k, i] = (flow, sum(r[3] or 0 for r in last[1:]), path)
    assert set(got) == set(paths)
    given = spark.createDataFrame([(k, i, p) for (k, i), (*_, p) in paths.items()], "k string, i int, path array<struct<x: double, y: double>>")
    for r in given.select("k", "i", path_fits(F.col("path")).alias("f")).collect():
        g, (flow, total, path) = got[r.k, r.i], paths[r.k, r.i]
        assert (g.flow, g.total, g.last_y) == (flow, total, path[-1]["y"])
        for name in NAMES:
            assert (g[name] is None) == (r.f[name] is None) and g[name] == (r.f[name] if r.f[name] is None else pytest.approx(r.f[name], rel=1e-9, abs=1e-9)), (r, g, name)
