"""Planted leads between paths, and levels that held, against brute force."""

import random

from barwright.operators.lags import best_lag, lagged_correlations, on_grid, steps
from barwright.operators.persistence import held_since


def test_a_planted_lead_is_found_and_unfilled_bins_never_count(spark):
    rng = random.Random(3)
    moves = [rng.gauss(0, 1) for _ in range(300)]
    leader = [sum(moves[: i + 1]) for i in range(300)]
    rows = [("lead", i, float(i), leader[i]) for i in range(300)]
    rows += [("follow", i, float(i), leader[i - 2] + rng.gauss(0, 0.05)) for i in range(2, 300) if not 100 <= i < 160]
    rows += [("noise", i, float(i), rng.gauss(0, 1)) for i in range(300)] + [("flat", i, float(i), 1.0) for i in range(300)] + [("few", i, float(i), leader[i]) for i in range(10)] + [("lead", 50, None, None), ("none", None, 1.0, 1.0)]
    paths = spark.createDataFrame(rows, "k string, bin long, t double, v double")
    grid = on_grid(paths, "k", "bin", "t", "v", 3)
    assert sorted(r.bin for r in grid.where("k = 'follow' AND bin BETWEEN 95 AND 165").collect()) == [*range(95, 103), *range(160, 166)]
    changes = steps(grid, "k")
    assert changes.where("k = 'follow' AND bin BETWEEN 103 AND 160").count() == 0
    pairs = spark.createDataFrame([("lead", f) for f in ("follow", "noise", "flat", "few")], "leader string, follower string")
    found = lagged_correlations(changes, pairs, "k", [0, 1, 2, 3])
    got = {r.follower: r for r in best_lag(found, 30).collect()}
    assert set(got) == {"follow", "noise"} and got["follow"].lag == 2 and got["follow"].rho > 0.95 and abs(got["noise"].rho) < 0.3
    # Changes of bins 3 to 102 and 161 to 302: three bins are carried on at the gap and at the end.
    assert got["follow"].n == 100 + 142 and lagged_correlations(changes.limit(0), pairs, "k", [0]).collect() == []


def test_levels_that_held_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([10.0, 11.0]), float(t), float(rng.choice([0, 1, 2, 3, 5, 8, 13, 40]))) for t in range(800)]
    rows += [("c", 1.0, float(t), float(t + 1)) for t in range(50)] + [("d", 1.0, float(t), 50.0 - t) for t in range(50)] + [("d", 1.0, None, 1.0), ("d", 1.0, 99.0, None)]
    got = {(r.k, r.p, r.t): r.since for r in held_since(spark.createDataFrame(rows, "k string, p double, t double, q double").repartition(3), ["k", "p"], "t", "q").collect()}
    assert len(got) == 900
    for k, p, t, q in rows:
        if t is None or q is None:
            continue
        own = sorted((u, v) for a, b, u, v in rows if (a, b) == (k, p) and u is not None and v is not None and u <= t)
        since = t
        for u, v in reversed(own):
            if v < 0.5 * q:
                break
            since = u
        assert got[k, p, t] == since
