import re
from collections import Counter, defaultdict

import pytest

from barwright.llm import mixing
from barwright.llm.q04_mixing import op4_mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_mixing(spark, sf_dir).collect()
    sizes = Counter()
    for r in docs.values():
        sizes[r.source] += words(r.text)
    targets, taken = brute_targets(sizes), defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == words(docs[r.doc_id].text) and r.source_size == sizes[source]
        assert r.target == pytest.approx(targets[source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    longest = {s: max(words(r.text) for r in docs.values() if r.source == s) for s in targets}
    for s, t in targets.items():
        assert taken[s] == pytest.approx(t, abs=longest[s] / 2 if sf == "sf0.001" else 0.05 * t)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op4_mixing(spark, sf_dir).collect()))


def test_edge_rows(spark):
    rows = [(1, "a b c", "s1"), (2, None, "s1"), (None, "x " * 50000, None), (3, "y", "s2"), (3, "y", "s2"), (4, "", "s3"), (5, "q r", "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS target", "2 AS whole", "7 AS rank")
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += words(r[1])
    targets = brute_targets(sizes)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got), key=str) == sorted(
        ((i, words(t), sizes[s], round(targets[s], 6)) for i, t, s in rows), key=str
    )
    taken = mixing.repeat_documents(docs).collect()
    assert list(taken[0].asDict()) == docs.columns
    assert sum(words(r.text) for r in taken) == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).collect() == [] == mixing.repeat_documents(docs.limit(0)).collect()


def test_equal_rows_share_their_copies(spark):
    """Null and empty sources are apart, and rows that differ in other columns alone get even parts."""
    rows = [(1, "a b", None, 1)] * 5 + [(1, "a b", "", 1)] * 3 + [(2, "c d e", "x", i % 2) for i in range(7)] + [(3, None, None, 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `odd.name` int")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source_size, r.size] += r.taken
    runs = [Counter(map(tuple, mixing.repeat_documents(docs.repartition(n)).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
    got = Counter()
    for (i, text, source, _), n in runs[0].items():
        size = {None: 10, "": 6, "x": 21}[source]
        got[i, size, words(text)] += n * words(text)
    assert +got == +want
    a, b = (runs[0][2, "c d e", "x", k] for k in (0, 1))
    assert abs(a / 4 - b / 3) <= 1


def test_a_giant_document_does_not_end_the_filling(spark):
    """Wherever the giants fall in the order, what fits is taken: 1,000 documents of 100 words and one that is too long."""
    rows = [(f"{s}-{i}", f"s{s}", 100 if i else 100_000) for s in range(12) for i in range(1001)]
    table = spark.createDataFrame([(i, s, n, 200_000, 50_000.0, 7) for i, s, n in rows], "id string, source string, size long, source_size long, target double, digest long")
    got, taken = mixing.draw(table).collect(), defaultdict(int)
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows) and {r.copies for r in got} == {0, 1}
    for r in got:
        taken[r.source] += r.size * r.copies
    assert dict(taken) == {f"s{s}": 50_000 for s in range(12)}
