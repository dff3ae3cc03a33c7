import datetime as dt
import time

from barwright.llm import urllists
from barwright.llm.q05_urllists import ORACLES, op5_urllists
from tests.llm.oracle import rows_of_query, same


def test_query_equals_sql(spark, sf_dir):
    same(spark, sf_dir, op5_urllists, ORACLES["op5_urllists"])
    verdicts = [r["verdict"] for r in rows_of_query(spark, sf_dir, op5_urllists)]
    assert {"block", "allow"} == set(verdicts)


D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
ENTRIES = [
    ("domain", "bad.com", D(0), "block"), ("host", "ok.bad.com", D(10), "allow"), ("host", "ok.bad.com", D(20), "remove"),
    ("url", "http://ok.bad.com/x", D(12), "block"), ("url", "http://ok.bad.com/x", D(12), "block"), ("domain", "bad.com", D(100), "remove"),
    (None, "bad.com", D(0), "block"), ("domain", None, D(0), "block"), ("domain", "bad.com", None, "block"), ("host", "late.org", D(900), "block"),
]
CAPTURES = [
    (1, "http://a.b.bad.com:80/q", D(0), "block", "bad.com"), (2, "http://OK.bad.com/", D(9), "block", "bad.com"),
    (3, "http://ok.bad.com/", D(10), "allow", "ok.bad.com"), (4, "http://ok.bad.com/x#f", D(12), "block", "http://ok.bad.com/x"),
    (5, "http://ok.bad.com/", D(20), "block", "bad.com"), (6, "http://ok.bad.com/", D(100), "allow", None), (7, None, D(5), "allow", None),
    (8, "http://bad.com/", None, "allow", None), (None, "http://u@bad.com./", D(99), "block", "bad.com"), (9, "", D(5), "allow", None),
    (9, "http://notbad.com/", D(5), "allow", None), (10, "http://late.org/", D(5), "allow", None), (1, "http://a.b.bad.com:80/q", D(0), "block", "bad.com"),
]


def test_edge_rows(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, key string, day date, action string").selectExpr("*", "1 AS bucket")
    captures = spark.createDataFrame([c[:3] for c in CAPTURES], "capture long, url string, fetched date").selectExpr("*", "1 AS key", "2 AS rank")
    for days in (1, 7, 30, 4000):
        got = [(r.capture, r.fetched, r.verdict, r.matched_key) for r in urllists.judge(captures, entries, days).collect()]
        assert sorted(got, key=str) == sorted(((c[0], *c[2:]) for c in CAPTURES), key=str)
    assert {r.verdict for r in urllists.judge(captures, entries.limit(0)).collect()} == {"allow"}
    assert urllists.judge(captures.limit(0), entries).collect() == []


def test_all_parents_of_a_long_host(spark):
    """Ten labels: entries for the registered domain and for each longer parent apply, one for the last label does not."""
    host = "a.b.c.d.e.f.g.h.example.com"
    keys = [host.split(".", i)[-1] for i in range(10)]
    for key, want in [(k, "block") for k in keys[:9]] + [(keys[9], "allow")]:
        entries = spark.createDataFrame([("domain", key, D(0), "block")], "kind string, key string, day date, action string")
        captures = spark.createDataFrame([(1, f"http://{host}/", D(1)), (2, "http://com/", D(1))], "capture long, url string, fetched date")
        assert {r.capture: r.verdict for r in urllists.judge(captures, entries).collect()} == {1: want, 2: "allow"}


def test_days_far_apart_and_a_list_much_larger_than_the_captures(spark):
    """One capture of the year 9999 and thousands of open-ended entries: rows follow captured (key, bucket) pairs, not days."""
    last = dt.date(9999, 12, 31)
    entries = spark.range(20_000).selectExpr("'host' AS kind", "concat('h', id % 4000, '.org') AS key", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day", "IF(id % 3 = 0, 'allow', 'block') AS action")
    captures = spark.createDataFrame([(1, "http://h7.org/", last), (2, "http://h7.org/", D(7)), (3, "http://h7.org/", D(6)), (4, "http://h9.org/", D(4009)), (5, "http://x.org/", last)], "capture long, url string, fetched date")
    began = time.monotonic()
    got = {r.capture: (r.verdict, r.valid_from) for r in urllists.judge(captures, entries).collect()}
    assert got == {1: ("block", D(16_007)), 2: ("block", D(7)), 3: ("allow", None), 4: ("block", D(4009)), 5: ("allow", None)}
    assert time.monotonic() - began < 60
