import math

import numpy as np
import pytest

from barwright.llm import ann
from barwright.llm.q09_ann import op9_ann


def euclid(q, v):
    total = 0.0
    for a, b in zip(q, v):  # in order and without the compensation of sum()
        total += (a - b) * (a - b)
    return math.sqrt(total)


def brute(rows, k=10, every=100):
    out = {}
    for i, q in rows:
        if i % every == 0:
            d = sorted((euclid(q, v), j) for j, v in rows if j != i)
            out[i] = d[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    vectors, want = dict(rows), brute(rows)
    got: dict = {}
    for r in op9_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        ordered = [found[i] for i in range(1, 11)]
        assert ordered == sorted(ordered)
        for score, j in ordered:
            assert score == euclid(vectors[q], vectors[j])
        hits += len({j for _, j in ordered} & {j for _, j in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_forest_finds_neighbours_in_many_leaves():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16))
    forest = ann.Forest(x[:1500], 8, 5)
    visits, at, hits = ann.visits_needed(forest, x[:1500], 10, 0.95), forest.leaves(x), 0
    assert visits < 8 * 32
    for i in range(0, 3000, 60):
        seen = np.zeros(len(x), bool)
        for t, leaf in forest.search(x[i], visits):
            seen |= at[t] == leaf
        d = ann.distances(x[i : i + 1], x)[0]
        hits += seen[np.argsort(d)[1:11]].sum()
    assert hits >= 0.9 * 500


def test_edge_rows(spark):
    copies = [(i, [1.0, 2.0]) for i in range(1, 60)]
    odd = [(200, None), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (700, [1.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 2.0]), (100, [5.0, 5.0]), (100, [5.0, 5.0]), *copies, *odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS leaf", "2 AS v")
    got = sorted(map(tuple, ann.neighbours(frame, block=7).collect()))
    d = math.sqrt(25)
    assert got == [*[(0, i, i, 0.0) for i in range(1, 11)], *[(100, i + 1, i, d) for i in range(10)]]
    few = ann.neighbours(frame.where("vec_id IN (0, 1)")).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert ann.neighbours(frame.limit(0)).collect() == [] == ann.neighbours(frame.where("vec_id = 200")).collect()


def test_clustered_vectors_need_few_distances():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((300, 24)) * 4, 20, axis=0) + rng.standard_normal((6000, 24)) * 0.3
    x = x[rng.permutation(len(x))]
    forest = ann.Forest(x[:3000], 12, 6)
    visits, at, hits, looked = ann.visits_needed(forest, x[:3000], 10, 0.94), forest.leaves(x), 0, 0
    for i in range(0, 6000, 100):
        seen = np.zeros(len(x), bool)
        for t, leaf in forest.search(x[i], visits):
            looked += int((at[t] == leaf).sum())
            seen |= at[t] == leaf
        hits += seen[np.argsort(ann.distances(x[i : i + 1], x)[0])[1:11]].sum()
    assert hits >= 0.9 * 600 and looked < 0.3 * 60 * len(x)


def test_search_goes_on_until_rows_are_enough(spark):
    """Leaves of a few rows each: all queries get ten neighbours; dealt-out queries find the same."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 3)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    some = {"every": 4, "leaf": 4, "recall": 0.0}
    got = sorted(map(tuple, ann.neighbours(frame, **some).collect()))
    assert [r[:2] for r in got] == [(q, i) for q in range(0, 400, 4) for i in range(1, 11)]
    assert sorted(map(tuple, ann.neighbours(frame, block=3, asked_rows=1, **some).collect())) == got
