import itertools

import numpy as np
import pytest
import xxhash

from barwright.llm import simhash
from barwright.llm.q03_simhash import op3_simhash

SCHEMA = "doc_id long, text string"


def brute_print(text, words=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, threshold=4):
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= threshold and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in prints}


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    classes = brute_classes(prints)
    rows = op3_simhash(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{prints[i]:016x}", classes[i]) for i in docs}
    assert len(rows) == len(docs)


def test_anchors_meet_for_every_pair_within_threshold():
    rng = np.random.default_rng(3)
    for d in range(5):
        for _ in range(200):
            a = rng.integers(0, 2**64, dtype=np.uint64)
            b = a
            for bit in rng.choice(64, d, replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
            x, y = (set(simhash.anchor_rows(np.array([v], np.uint64).view(np.int64), 4)[0].tolist()) for v in (a, b))
            assert x & y


@pytest.mark.parametrize("part", [4, 64, 8192])
def test_crowded_anchors_keep_every_link(spark, part):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    prints = {base}
    while len(prints) < 150:
        p = base
        for bit in rng.choice(40, 3, replace=False):
            p ^= 1 << int(bit)
        prints.add(p)
    prints |= {int(x) for x in rng.integers(0, 2**62, 50)}
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "print long"), 4, part).collect()
    assert all((r.u ^ r.v).bit_count() <= 4 for r in found)
    root = {p: p for p in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        root[max(top(r.u), top(r.v))] = min(top(r.u), top(r.v))
    want = brute_classes({p: p for p in prints})
    assert {p: top(p) for p in prints} == want


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b"), (5, "a b"), (5, "a b"), (6, "w " * 30000), (7, "A  B")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fingerprint", "2 AS print", "3 AS root")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_classes(docs).collect()), key=str)
    as_signed = lambda t: brute_print(t) - (brute_print(t) >> 63 << 64)
    want = [(1, 0, 1), (2, 0, 1), (3, 0, 1), (None, as_signed("a b"), 5), (5, as_signed("a b"), 5), (5, as_signed("a b"), 5), (6, as_signed("w " * 8), 6), (7, as_signed("a b"), 5)]
    assert got == sorted(want, key=str)
    assert simhash.near_classes(docs.limit(0)).collect() == []
