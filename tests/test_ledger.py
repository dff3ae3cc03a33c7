"""Drops of a queue against volume: planted cases and every event one by one."""

import random
from collections import defaultdict

import pytest

from barwright.operators.ledger import drops, settle

SCHEMA = "key string, t double, seq int, kind string, id long, quantity double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ledger(spark, rows, lag=90.0):
    found = drops(settle(frame(spark, rows), "key", lag), "key").collect()
    return {(r.key, r.id): (r.kind, r.quantity, round(r.traded, 6), round(r.pulled, 6), round(r.open, 6)) for r in found}


def test_what_is_traded_is_bounded_by_volume(spark):
    rows = [
        ("a", 5.0, 0, "bid", 1, 200.0), ("a", 10.0, 0, "volume", 2, 150.0), ("a", 100.0, 0, "volume", 3, 0.0), ("a", 110.0, 0, "volume", 4, 200.0),
        ("a", 115.0, 0, "ask", 5, 300.0), ("a", 215.0, 0, "bid", 6, 350.0), ("b", 1.0, 0, "bid", 7, 10.0), (None, 3.0, 0, "ask", 8, 1.0), ("c", None, 0, "bid", 9, 5.0), ("c", 1.0, 0, "volume", 10, 5.0),
    ]
    assert ledger(spark, rows) == {
        ("a", 1): ("bid", 200, 150, 50, 0), ("a", 5): ("ask", 300, 200, 100, 0), ("a", 6): ("bid", 350, 0, 0, 350), ("b", 7): ("bid", 10, 0, 0, 10), (None, 8): ("ask", 1, 0, 0, 1),
    }
    pulled = settle(frame(spark, rows), "key", 90.0).where("entry = 'pulled'").collect()
    assert sorted((r.id, r.at, r.quantity) for r in pulled) == [(1, 95.0, 50.0), (5, 205.0, 100.0)]
    assert settle(frame(spark, []), "key", 90.0).collect() == []


def test_the_oldest_go_first_and_nothing_twice(spark):
    rows = [("a", 0.0, 1, "bid", 1, 100.0), ("a", 0.0, 2, "ask", 2, 100.0), ("a", 50.0, 0, "bid", 3, 100.0), ("a", 60.0, 0, "volume", 4, 150.0), ("a", 95.0, 0, "volume", 5, 500.0), ("a", 100.0, 0, "bid", 6, 30.0), ("a", 190.5, 0, "bid", 7, 1.0)]
    assert ledger(spark, rows) == {("a", 1): ("bid", 100, 100, 0, 0), ("a", 2): ("ask", 100, 50, 50, 0), ("a", 3): ("bid", 100, 100, 0, 0), ("a", 6): ("bid", 30, 30, 0, 0), ("a", 7): ("bid", 1, 0, 0, 1)}


def brute(rows, lag):
    """Each event against a plain list of all that is open for its key, whatever the time between."""
    out, last = {}, defaultdict(float)
    for k, t, *_ in rows:
        last[k] = max(last[k], t)
    for key in {r[0] for r in rows}:
        volumes, open_ = [], []
        for _, t, _, kind, i, q in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if kind != "volume":
                out[key, i] = [kind, q, 0.0, 0.0, 0.0]
            for e in [e for e in (open_ if kind == "volume" else volumes) if e[0] >= t - lag]:
                take = min(q, e[1])
                e[1], q = e[1] - take, q - take
                out[key, e[2] if kind == "volume" else i][2] += take
            (volumes if kind == "volume" else open_).append([t, q, i])
    for key, t, _, kind, i, q in rows:
        if kind != "volume":
            e = out[key, i]
            e[3 if last[key] > t + lag else 4] = q - e[2]
    return {k: (e[0], e[1], *(round(x, 6) for x in e[2:])) for k, e in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_event_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows, t = [], defaultdict(float)
    for i in range(3000):
        key = rng.choice("aaaaaaabc")
        t[key] += rng.choice([0.0, 1.0, 7.0, 30.0, 91.0, 200.0])
        rows.append((key, t[key], i, rng.choice(["volume", "bid", "ask"]), i, float(rng.randint(1, 50))))
    shuffled = rng.sample(rows, len(rows))
    assert ledger(spark, shuffled) == brute(rows, 90.0)
