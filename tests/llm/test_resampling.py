import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from barwright.llm import resampling
from barwright.llm.q11_resampling import ORACLES, op11_resampling
from tests.llm.oracle import same

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    same(spark, f"/root/testdata/{sf}", op11_resampling, ORACLES["op11_resampling"])


def grams(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, percent, least):
    features = [grams(t, longest) for _, t in docs]
    s, t = Counter(), Counter()
    for _, fs in features:
        s.update(zlib.crc32(f.encode()) % buckets for f in fs)
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in grams(text, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for (i, _), (w, fs) in zip(docs, features):
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [r[:5] for r in rows]


DOCS = [
    (1, "Some words, some WORDS: and 3more"), (2, None), (3, ""), (4, "..."), (None, "a b c d e f"), (5, "über ÉCOLE naïve\x00x\x7fy 日本 語"), (5, "another text of five"),
    (6, "z " * 50_000), (7, "y" * 200_000 + " end"), (8, "a b c d e f"), (9, "a b c d e f"), (8, "a b c d e f"), (-10, "-- lead and trail --"),
] + [(100 + i, f"w{i} w{i % 7} and the w{i % 3} of it") for i in range(150)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97), (2, 10_000)])
def test_edge_rows_equal_brute_force(spark, longest, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "TEXT_BYTES", 2000)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS n", "3 AS score", "4 AS `rank`", "5 AS `a.b`").repartition(5)
    texts = [None, "", "the w3 of it and the w1", "a b c and école"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, text string")
    weighed = resampling.weigh_against(docs, target, longest, buckets)
    got = [[r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in resampling.rank(weighed, 30, 4).collect()]
    want = brute(DOCS, texts, longest, buckets, 30, 4)
    assert sorted(got, key=str) == sorted(want, key=str)
    drawn = resampling.resample(docs, target, longest, buckets, 30, 4)
    ids = {r[0] for r in want if r[4]}
    assert drawn.columns == docs.columns and sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(i) for i, _ in DOCS if i in ids)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.rank(resampling.weigh_against(none, docs)).collect() == []
    got = resampling.rank(resampling.weigh_against(docs, none), 100, 0).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(DOCS) + 1))


def test_what_looks_like_the_target_is_drawn(spark):
    """A tenth of the documents is written in the target's words: nearly all of it is drawn."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 40), k -> concat(IF(id % 10 = 3, 'in', 'out'), pmod(hash(id, k), 300))), ' ') AS text")
    target = spark.range(50).selectExpr("array_join(transform(sequence(1, 40), k -> concat('in', pmod(hash(id, k, 1), 300))), ' ') AS text")
    drawn = [r.doc_id for r in resampling.resample(docs, target).collect()]
    assert len(drawn) == 200 and sum(i % 10 == 3 for i in drawn) >= 150
