import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwright.llm import lmscore
from barwright.llm.q13_lmscore import op13_lmscore
from tests.llm.oracle import rows_of_query

LOWER = {c: c + 32 for c in range(65, 91)}
M64 = (1 << 64) - 1


def tokens(text):
    return [w for w in re.split("[ \t-\r]", (text or "").translate(LOWER)) if w] + [lmscore.END]


def remainder(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def brute_base(docs):
    counts = Counter(t for i, text in docs if remainder(i) != 0 for t in tokens(text))
    n, v = counts.total(), len(counts)
    out = []
    for i, text in docs:
        own = tokens(text)
        out.append((i, remainder(i) == 0, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return out


def same_base(got, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for g, w in zip(got, sorted(brute_base(docs), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_query_base_and_held_out_scores(spark):
    """The base equals brute force, and held-out texts are more probable under the mixer, which spells unknown words, than under the base."""
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of_query(spark, sf, op13_lmscore)
    same_base(got, docs)
    held = [r for r in got if r["held_out"]]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_score(model, text):
    """One text bit by bit with Python's whole numbers and doubles."""
    weights, total = model.weights.astype(float).copy(), 0.0
    seen, stream = Counter(), []
    for t in tokens(text):
        best = max((n for n in seen.values()), default=0)
        leader = next((k + 1 for k, w in enumerate(model.leaders) if best and seen[w] == best), 0)
        word = b"\xff" if t == lmscore.END else t.encode() + b" "
        whole, power = 0, 1
        for j, byte in enumerate(word):
            contexts = []
            for k, (n, led) in enumerate(lmscore.CONTEXTS):
                h = int.from_bytes(word[max(0, j - n) : j], "big") if n else whole
                h = (h + k + 1 + ((leader + 1) * int(lmscore._M2) if led else 0)) * int(lmscore._M1) & M64
                h = (h ^ h >> 29) * int(lmscore._M2) & M64
                contexts.append(h >> 64 - (len(model.tables[k]).bit_length() - 1))
            whole, power = whole + (byte + 1) * power & M64, power * lmscore._P & M64
            pair = int(model.code.row[word[j - 1] if j else 0]) * 256 + byte
            for depth in range(model.code.length[pair]):
                node, bit = int(model.code.node[pair, depth]), int(model.code.bit[pair, depth])
                slots = [c ^ (node * 389 + 1 & 1023) for c in contexts]
                x = [int(table[s]) for table, s in zip(model.tables, slots)] + [0] * (7 - len(slots)) + [lmscore.SCALE]
                level = int(model.sure[slots[lmscore.SURE]])
                gate = 3 * (level + 3 if level else sum(v != 0 for v in x[:3])) + min(depth, 2)
                stream.append((x, gate, bit))
        if t in model.leaders:
            seen[t] += 1
    at, block = 0, 256
    while at < len(stream):
        slopes, n = {}, Counter()
        for x, gate, bit in stream[at : at + block]:
            z = sum(a * b for a, b in zip(x, weights[gate]))
            p = 1 / (1 + math.exp(-z))
            total += math.log10(p if bit else 1 - p)
            slopes[gate] = slopes.get(gate, 0) + (bit - p) * np.array(x, float)
            n[gate] += 1
        for gate, s in slopes.items():
            weights[gate] += lmscore.OWN_RATE / lmscore.SCALE**2 / (1 + n[gate] / lmscore.HALF) * s
        at, block = at + block, min(8192, block if at == 0 else 2 * block)
    return total


DOCS = [
    (1, "Some words, SOME words and more of the same"), (2, None), (3, ""), (4, " \n\t "), (None, "a text without id"), (None, None), (6, "long " * 3000), (7, "x" * 8_000),
    (8, "naïve ÉCOLE 日本 語 \x00 nul"), (9, "Some words, SOME words and more of the same"), (9, "Some words, SOME words and more of the same"), (9, "other text, same id"), (-5, "negative"),
] + [(100 + i, f"the w{i} of the w{i % 7} and und der la w{i % 3} |") for i in range(120)]


def test_scores_equal_a_bitwise_version(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS chunk", "3 AS held_out", "4 AS `a.b`").repartition(4)
    rows = docs.select("doc_id", "text")
    counts, model = lmscore.train(rows.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0))
    got = lmscore.score(rows.withColumn("held_out", F.lit(True)), counts, model).collect()
    assert model.leaders and model.weights.std() > 0
    want = sorted((str(i), round(brute_score(model, t), 2)) for i, t in DOCS)
    assert [(i, pytest.approx(s, rel=1e-3, abs=0.02)) for i, s in want] == sorted((str(r.doc_id), round(r.score, 2)) for r in got)
    assert {r.doc_id: r.n_bytes for r in got if r.doc_id in (1, 2, 6)} == {1: 45, 2: 1, 6: 15_001}
    # A text alone, or among others in a slice of its own, has the score it has among all.
    few = lmscore.score(rows.where("doc_id = 6 OR doc_id = 1").withColumn("held_out", F.lit(True)), counts, model).collect()
    assert all(r.score == pytest.approx(next(g.score for g in got if g.doc_id == r.doc_id), rel=1e-6) for r in few)
    same_base(lmscore.score_documents(docs).collect(), DOCS)


def test_empty_tables_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert lmscore.score_documents(docs.limit(0)).collect() == []
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    got = lmscore.score_documents(held).collect()
    assert got and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)


def test_code_is_a_prefix_code_and_leaders_follow_the_text():
    counts = np.zeros((256, 256), np.int64)
    counts[0, 97], counts[97, 98] = 50, 70
    code = lmscore.Code(counts)
    for before in (0, 97, 5):
        own = range(code.row[before] * 256, code.row[before] * 256 + 256)
        paths = {tuple(code.bit[i, : code.length[i]]) for i in own}
        assert len(paths) == 256 and sum(2.0 ** -len(p) for p in paths) == 1
    assert [int(code.length[code.row[x] * 256 :][:256].argmin()) for x in (0, 97, 5)] == [97, 98, 98]
    words, numbers, ends = lmscore.cut(pa.array(["a the b la c la d", None, "la x"]))
    under, leader, places = lmscore.led(words, numbers, ends, ["the", "la"])
    assert [(under[p].as_py(), int(leader[p])) for p in places] == [
        ("a", 0), ("the", 0), ("b", 1), ("la", 1), ("c", 1), ("la", 1), ("d", 2), (" ", 2), (" ", 0), ("la", 0), ("x", 2), (" ", 2),
    ]


def bits_of(model, t, leader):
    """(slots, depth in the byte, bit) of each bit of a word under a leader."""
    word = b"\xff" if t == lmscore.END else t.encode() + b" "
    whole, power = 0, 1
    for j, byte in enumerate(word):
        contexts = []
        for k, (n, led) in enumerate(lmscore.CONTEXTS):
            h = int.from_bytes(word[max(0, j - n) : j], "big") if n else whole
            h = (h + k + 1 + ((leader + 1) * int(lmscore._M2) if led else 0)) * int(lmscore._M1) & M64
            h = (h ^ h >> 29) * int(lmscore._M2) & M64
            contexts.append(h >> 64 - (len(model.tables[k]).bit_length() - 1))
        whole, power = whole + (byte + 1) * power & M64, power * lmscore._P & M64
        pair = int(model.code.row[word[j - 1] if j else 0]) * 256 + byte
        for depth in range(model.code.length[pair]):
            yield [c ^ (int(model.code.node[pair, depth]) * 389 + 1 & 1023) for c in contexts], depth, int(model.code.bit[pair, depth])


def test_leaders_and_first_weights_come_from_all_training_documents(spark):
    """One Newton step over all occurrences, each with the counts of all others; no share of the documents is a sample for it."""
    docs = [(i, ("alpha " if remainder(i) == 9 else "beta information ") * 3 + f"inform w{i}") for i in range(1, 61) if remainder(i) != 0]
    assert any(remainder(i) == 9 for i, _ in docs)
    model = lmscore.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))[1]
    assert model.leaders[:2] == ["beta", "information"]
    bits = []
    for _, text in docs:
        seen = Counter()
        for t in tokens(text):
            best = max(seen.values(), default=0)
            bits += bits_of(model, t, next((k + 1 for k, w in enumerate(model.leaders) if best and seen[w] == best), 0))
            seen[t] += t in model.leaders
    counts = Counter((k, s, bit) for slots, _, bit in bits for k, s in enumerate(slots))
    start = np.array([lmscore.FIRST / lmscore.SCALE] * 7 + [0])
    slope, bend = np.zeros((lmscore.GATES, 8)), np.zeros((lmscore.GATES, 8, 8))
    for slots, depth, bit in bits:
        n = [[counts[k, s, b] - (b == bit) for b in (0, 1)] for k, s in enumerate(slots)]
        x = np.array([np.rint(np.clip(lmscore.SCALE * math.log((one + 0.4) / (zero + 0.4)), -127, 127)) for zero, one in n] + [0] * (7 - len(n)) + [lmscore.SCALE])
        level = sum(sum(n[lmscore.SURE]) >= v for v in lmscore.LEVELS)
        gate = 3 * (level + 3 if level else np.count_nonzero(x[:3])) + min(depth, 2)
        p = 1 / (1 + math.exp(-(x @ start)))
        slope[gate] += (bit - p) * x
        bend[gate] += p * (1 - p) * np.outer(x, x)
    want = [start + np.linalg.solve(b + np.eye(8) * (lmscore.SCALE / lmscore.FIRST) ** 2, s) for s, b in zip(slope, bend)]
    assert np.abs(np.array(want) - start).max() > 1e-3
    np.testing.assert_allclose(model.weights, want, rtol=1e-3, atol=1e-6)


def test_letters_shared_with_the_word_before_are_looked_up_once():
    words = ["in", "inform", "information", "informed", "informed", "x" * 40, "x" * 40 + "y", lmscore.END]
    letters, sizes = lmscore.spelled(words)
    fresh, same = lmscore.shared(letters, sizes, np.array([0, 0, 0, 0, 1, 1, 1, 1]))
    ends, kept = np.cumsum(sizes), {}
    for w, (start, stop) in enumerate(zip(ends - sizes, ends)):
        for j in range(start, stop):
            assert letters[start : j + 1].tobytes() == kept.setdefault(int(same[j]), letters[start : j + 1].tobytes())
    assert len(kept) == len(fresh) < len(letters) and sorted(kept) == list(range(len(fresh)))
