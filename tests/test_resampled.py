"""Bootstrap of an AUC against one replicate after the other with the same digests."""

import hashlib
import random

import pytest

from barwright.operators.resampled import POISSON, auc_draws, interval

DRAWS = 25


def weight(block, draw):
    u = int(hashlib.md5(f"{block}|{draw}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return 1 if draw == 0 else sum(u >= p for p in POISSON)


def brute(rows, draw):
    up, down = ([(s, weight(b, draw)) for s, y, b in rows if y == want and s is not None and b is not None] for want in (1, 0))
    total = sum(w for _, w in up) * sum(w for _, w in down)
    return sum(a * b * (1 if s > t else 0.5 if s == t else 0) for s, a in up for t, b in down) / total if total else None


def test_draws_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(float(rng.choice([*range(30), 7, 7, 7])), rng.randint(0, 1), f"s{rng.randint(0, 9)}") for _ in range(400)] + [(None, 1, "s1"), (1.0, None, "s1"), (1.0, 1, None)]
    df = spark.createDataFrame(rows, "score double, y int, block string").repartition(4)
    got = {r.draw: r.auc for r in auc_draws(df, "score", "y", "block", DRAWS).collect()}
    assert sorted(got) == list(range(DRAWS + 1))
    for d, auc in got.items():
        assert auc == pytest.approx(brute(rows, d), abs=1e-12)
    draws = auc_draws(df, "score", "y", "block", DRAWS)
    b = draws.agg(interval(draws, "auc").alias("i")).first().i
    values = sorted(v for d, v in got.items() if d)
    assert values[0] <= b.lo < b.hi <= values[-1]


def test_few_rows_and_one_outcome(spark):
    df = spark.createDataFrame([(1.0, 1, "a"), (2.0, 1, "b")], "score double, y int, block string")
    assert {r.auc for r in auc_draws(df, "score", "y", "block", 3).collect()} == {None}
    assert auc_draws(df.limit(0), "score", "y", "block", 3).collect() == []
