import numpy as np
import pytest

from barwright.llm import nearcopies
from barwright.llm.nearcopies import drop_near_copies
from barwright.llm.simhash import shingle_hashes

SCHEMA = "doc_id long, text string"


def sets_of(texts):
    return [set(shingle_hashes(t.encode(), 5, 42).tolist()) for t in texts]


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y) - 1e-9


def components(sets):
    """All pairs, by brute force."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


def variants(rng, sizes, copies):
    texts = []
    for n in sizes:
        a = [f"w{i}" for i in rng.integers(0, 3000, n)]
        texts.append(a)
        for places in ([n // 2], [n // 3], [3, n - 4])[: int(rng.integers(1, copies + 1))]:
            texts.append([*a])
            for i in places:
                texts[-1][i] = f"x{len(texts)}"
    return [" ".join(texts[i]) for i in rng.permutation(len(texts))]


def check(texts, kept):
    """No two that stay are similar, and each row is linked to one that stays."""
    sets = sets_of(texts)
    root = components(sets)
    assert not any(alike(sets[i], sets[j]) for i in kept for j in kept if i < j)
    assert {root[i] for i in kept} == set(root)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b"), (5, "a b"), (5, "a b"), (6, "w " * 30000), (7, "A  B"), (None, "a b"), (None, "c d"), (None, "c d")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS a", "2 AS a_", "3 AS id_", "4 AS token", "5 AS `n.x`", "6 AS rows")
    kept = drop_near_copies(docs).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == ["1", "5", "6", "None"]
    assert list(kept[0].asDict()) == docs.columns
    assert drop_near_copies(docs.limit(0)).collect() == []


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    a = list(rng.choice(words, 300))
    b, c = a.copy(), list(rng.choice(words, 300))
    b[7] = "changed"
    half = a[:150] + c[:150]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(half)), (5, " ".join(a))], SCHEMA)
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 3, 4]


@pytest.mark.parametrize("limits", [(nearcopies.PAIRED, nearcopies.GROUP), (2, 4)])
def test_short_near_copies_go(spark, monkeypatch, limits):
    """Pairs from 0.8 up, whose fingerprints mostly differ in far more than 4 bits; also with all groups crowded."""
    monkeypatch.setattr(nearcopies, "PAIRED", limits[0])
    monkeypatch.setattr(nearcopies, "GROUP", limits[1])
    texts = variants(np.random.default_rng(8), [50, 60, 80, 100, 120] * 12, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = [r.doc_id for r in drop_near_copies(docs).collect()]
    check(texts, kept)
    assert len(kept) < 0.8 * len(texts)


def test_large_group_of_near_copies(spark):
    """Hundreds of variants of one text, chained ones among them, beside others that share a passage with it."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 3000, 200)]
    texts = []
    for k in range(400):
        a = base.copy()
        for i in rng.integers(0, 200, 1 + k % 6):
            a[i] = f"y{k}{i}"
        texts.append(" ".join(a))
    texts += [" ".join([*base[:60], *(f"z{k}_{i}" for i in range(120))]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = [r.doc_id for r in drop_near_copies(docs).collect()]
    check(texts, kept)
    assert set(range(400, 460)) <= set(kept)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_all_pairs_of_documents(spark, sf):
    """Against all pairs of ``documents`` that share a shingle, counted by brute force."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").dropna(subset=["text"])
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    sets = {i: set(shingle_hashes(t.encode(), 5, 42).tolist()) for i, t in rows.items()}
    owners: dict = {}
    for i in kept:
        for h in sets[i]:
            owners.setdefault(h, []).append(i)
    shared: dict = {}
    for own in owners.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                shared[i, j] = shared.get((i, j), 0) + 1
    assert not [(i, j) for (i, j), both in shared.items() if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    # Each that went has a similar text, be it one that stays or one that went.
    lost = set(rows) - kept
    by_shingle: dict = {}
    for i, s in sets.items():
        for h in s:
            by_shingle.setdefault(h, []).append(i)
    for i in lost:
        near = {j for h in sets[i] for j in by_shingle[h]} - {i} if sets[i] else {j for j in rows if not sets[j]} - {i}
        assert any(alike(sets[i], sets[j]) for j in near)
