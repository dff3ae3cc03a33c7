"""Lagged pairs whose leaders are sent to all tasks, or met in a shuffle: the same rows."""

import random

from barwright.operators import lags


def test_few_and_many_leaders_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    changes = spark.createDataFrame([(s, b, rng.gauss(0, 1) if s != "e" else 0.0) for s in "abcde" for b in range(60) if rng.random() < 0.8], "s string, bin long, r double")
    pairs = spark.createDataFrame([(a, b) for a in "abe" for b in "abcde" if a != b], "leader string, follower string")
    found = lambda: {(r.leader, r.follower, r.lag): (r.n, r.rho and round(r.rho, 12)) for r in lags.lagged_correlations(changes, pairs, "s", [0, 1, 3]).collect()}
    few = found()
    assert len(few) == 36 and few["e", "a", 0][1] is None and few["a", "b", 1][1] is not None
    monkeypatch.setattr(lags, "FEW", 2)
    assert found() == few
