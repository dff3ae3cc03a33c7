"""Earlier and smaller rows against counting them one by one."""

import random

import numpy as np
import pytest

from barwright.operators import causal
from barwright.operators.causal import earlier_below, smaller_before


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_smaller_before(n):
    v = np.random.default_rng(n).integers(0, 20, n).astype(float)
    assert smaller_before(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]


def test_counts_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [("hot", t, float(rng.choice([1, 2, 2, 3, 50, rng.random() * 100]))) for t in rng.sample(range(100_000), 1500)]
    rows += [(k, t, rng.gauss(0, 1)) for k in "abc" for t in rng.sample(range(1000), 40)] + [("a", None, 1.0), ("a", 5000, None), ("one", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    got = {(r.k, r.t): (r.earlier, r.below) for r in earlier_below(df, "k", "t", "v").collect()}
    fine = [r for r in rows if r[1] is not None and r[2] is not None]
    assert len(got) == len(fine)
    for k, t, v in fine:
        past = [x for a, u, x in fine if a == k and u < t]
        assert got[k, t] == (len(past), sum(x < v for x in past))
    assert earlier_below(df.limit(0), "k", "t", "v").collect() == []


@pytest.mark.parametrize("whole, batch", [(1_000_000, 7), (30, 7), (30, 10_000)])
def test_keys_counted_whole_and_in_ranges_give_the_same(spark, monkeypatch, whole, batch):
    monkeypatch.setattr(causal, "WHOLE", whole)
    rng = random.Random(8)
    rows = [(k, t, float(rng.randrange(9))) for k, n in (("a", 90), ("b", 5), ("c", 31), (None, 40), ("d", 1), ("e", 30)) for t in rng.sample(range(500), n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.k, r.t): (r.earlier, r.below) for r in earlier_below(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, t): (len(p := [x for a, u, x in rows if a == k and u < t]), sum(x < v for x in p)) for k, t, v in rows}
