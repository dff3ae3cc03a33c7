import re
from collections import Counter, defaultdict
from itertools import permutations

from barwright.llm import audit
from barwright.llm.q12_audit import ORACLES, op12_audit
from tests.llm.oracle import same


def test_query_equals_sql(spark, sf_dir):
    same(spark, sf_dir, op12_audit, ORACLES["op12_audit"])


def brute(docs, labels):
    """Every order applied document by document."""
    first, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split("[ \t-\r]", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and first[t] < i,
        }
        parts[s or ""].append((i, {k for k, v in fails.items() if v}))
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                failing = [r for r in rows if x in r[1]]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), len(failing) - len(gone), sum(r[1] == {x} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), x,
                ]
                shapley[x] += len(gone)
                left = kept
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return out


LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (4, None, None), (5, "", None), (6, "same " * 300, "a"), (7, "THE CAPS " * 150, "a"), (None, LONG, "a"),
    (8, LONG + " 5%", "b"), (9, "x | y", "a"), (9, "Y Z", "a"), (10, "one\ttwo\n", ""), (-1, "THE CAPS " * 150, "c"), (None, None, "c"), (11, " \n ", "c"), (12, "w" * 300_000 + LONG, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (10, 1, 1)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_edge_rows_equal_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "'x' AS hash", "2 AS n", "3 AS part", "4 AS `a.b`")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "5 AS good", "6 AS n")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in audit.audit(docs, labels).collect()}
    assert got == brute(DOCS, LABELS)
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert len(audit.audit(docs, labels.limit(0)).collect()) == 600 * 4


def test_a_large_group_of_copies_fails_but_for_its_first(spark):
    """Half of the table is one text: all of it but the smallest id fails E, in whatever part."""
    docs = spark.range(4000).selectExpr("id AS doc_id", f"IF(id % 2 = 0, '{LONG}', concat('{LONG}', id)) AS text", "concat('s', id % 3) AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.part: r for r in audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").collect()}
    assert sum(r.removed for r in found.values()) == 1999 and sum(r.kept for r in found.values()) == 2001
    assert all(r.unique_fails == r.removed for r in found.values())
