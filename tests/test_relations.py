"""The tree of minimum description length against one grown case by case."""

import math
import random
from collections import Counter

import pytest

from barwright.operators import relations
from barwright.plans.relations_queries import CATEGORICAL, NUMERIC, cases, relation_tree


def code(n):
    return 1 + math.log2(max(1, n))


def emp(outcomes):
    n, c = len(outcomes), Counter(outcomes)
    return 0.0 if n <= 1 else code(len(c)) - sum(k * math.log2(k / n) for k in c.values())


def brute(rows, numeric, left, node="", depth=0):
    """Every field and cut of every node tried on its own list of cases; yields (node, depth, cases, field, cut)."""
    best = None
    for f in sorted(left):
        have = [r for r in rows if r[f] is not None]
        options = []
        if f in numeric:
            xs = sorted({r[f] for r in have})
            for a, b in zip(xs, xs[1:]):
                cut = (a + b) / 2
                parts = {f"<={cut}": [r for r in have if r[f] <= cut], f">{cut}": [r for r in have if r[f] > cut], "=MISSING": [r for r in rows if r[f] is None]}
                options.append((cut, len(xs) - 1, {k: v for k, v in parts.items() if v}))
        else:
            parts = {}
            for r in rows:
                parts.setdefault(f"={r[f] if r[f] is not None else 'MISSING'}", []).append(r)
            if len(parts) > 1:
                options.append((None, 1, parts))
        for cut, candidates, parts in options:
            bits = 1 + math.log2(len(left)) + math.log2(candidates) + code(len(parts)) + sum(emp([r["y"] for r in p]) for p in parts.values())
            if best is None or round(bits, 6) < round(best[0], 6):
                best = (bits, f, cut, parts)
    leaf = 1 + emp([r["y"] for r in rows])
    if best is None or len(rows) <= 1 or len({r["y"] for r in rows}) <= 1 or round(best[0], 6) >= round(leaf, 6):
        yield (node, depth, len(rows), None, None)
        return
    yield (node, depth, len(rows), best[1], best[2])
    for k, p in best[3].items():
        yield from brute(p, numeric, [x for x in left if x != best[1]], f"{node}/{best[1]}{k}", depth + 1)


def got(tree):
    return sorted(((r.node, r.depth, r.cases, r.field, r.cut) for r in tree.collect()), key=str)


def planted(n, seed):
    """'up' needs a high pressure in an open session; in the morning the spread decides instead. The rest is noise."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        r = {"pressure": rng.choice([None, *range(20)]), "session": rng.choice(["open", "morning", "closed", None]), "spread": round(rng.random(), 2), "noise": rng.randint(0, 9)}
        up = r["session"] == "open" and (r["pressure"] or 0) >= 12 or r["session"] == "morning" and r["spread"] < 0.3
        r["y"] = rng.choice(["up", "flat"]) if rng.random() < 0.05 else "up" if up else "flat"
        rows.append(r)
    return rows


FIELDS = (["noise", "pressure", "spread"], ["session"])
SCHEMA = "pressure double, session string, spread double, noise double, y string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(None if r[c] is None else float(r[c]) if c in FIELDS[0] else r[c] for c in ("pressure", "session", "spread", "noise", "y")) for r in rows], SCHEMA)


def test_planted_relations_are_found(spark):
    rows = [{k: float(v) if k in FIELDS[0] and v is not None else v for k, v in r.items()} for r in planted(1500, 3)]
    tree = got(relations.grow_tree(frame(spark, rows), "y", *FIELDS))
    assert tree == sorted(brute(rows, FIELDS[0], sorted(FIELDS[0] + FIELDS[1])), key=str)
    fields = {n: f for n, _, _, f, _ in tree}
    assert fields[""] == "session" and fields["/session=open"] == "pressure" and fields["/session=morning"] == "spread" and fields["/session=closed"] is None
    assert next(c for n, _, _, _, c in tree if n == "/session=open") == pytest.approx(11.5)


def test_noise_has_no_relation_and_edges(spark):
    rng = random.Random(1)
    rows = [{"pressure": float(rng.randint(0, 50)), "session": rng.choice("abc"), "spread": rng.random(), "noise": None, "y": rng.choice("uv")} for _ in range(400)]
    assert got(relations.grow_tree(frame(spark, rows), "y", *FIELDS)) == [("", 0, 400, None, None)]
    one = [{"pressure": 1.0, "session": None, "spread": None, "noise": None, "y": "u"}]
    assert got(relations.grow_tree(frame(spark, one), "y", *FIELDS)) == [("", 0, 1, None, None)]
    assert relations.grow_tree(frame(spark, one).limit(0), "y", *FIELDS).collect() == []
    pair = [dict(one[0], y=y, pressure=p) for y, p in [("u", 1.0), (None, 5.0)] * 30]
    tree = got(relations.grow_tree(frame(spark, pair), "y", *FIELDS))
    assert tree == [("", 0, 60, "pressure", 3.0), ("/pressure<=3.0", 1, 30, None, None), ("/pressure>3.0", 1, 30, None, None)]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [r.asDict() for r in cases(spark, sf_dir).withColumnRenamed("outcome", "y").collect()]
    tree = got(relation_tree(spark, sf_dir))
    assert tree == sorted(brute(rows, NUMERIC, sorted(NUMERIC + CATEGORICAL)), key=str) and len(tree) > 3
