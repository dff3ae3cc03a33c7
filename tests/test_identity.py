"""Planted claims: conflicts are shown, floating claims placed only where one exchange is possible, companies connected."""

import datetime as dt
import random

from barwright.operators.identity import components, listings, placed, resolutions, reused_ids

D = lambda n: dt.date(2026, 1, n)
CLAIMS = [
    ("a", "X", "AAA", D(1), {"company_id": "1", "sector": "bank"}), ("b", "X", "AAA", D(2), {"company_id": "1", "sector": "Bank "}), ("a", "X", "AAA", D(3), {"company_id": "7"}),
    ("c", None, "AAA", D(2), {"sector": None}), ("c", " ", "TWO", D(2), {"company_id": "2"}), ("a", "X", "TWO", D(1), {}), ("a", "Y", "TWO", D(3), {"company_id": "9"}),
    ("a", "X", "NEW", D(1), {"company_id": "1"}), ("a", "X", "BAD", D(1), {"company_id": "4"}), ("b", "X", "BAD", D(1), {"company_id": "5"}), ("b", None, "LOST", D(3), {"company_id": "6"}),
    ("b", "X", None, D(1), {"company_id": "1"}), ("b", "X", "", D(1), {}), ("d", "Y", "SOLO", D(3), None),
]
SCHEMA = "source string, exchange string, code string, as_of date, attributes map<string, string>"


def test_planted_claims(spark):
    claims = spark.createDataFrame(CLAIMS, SCHEMA)
    got = {(r.exchange, r.code): r for r in listings(claims, ["company_id"], "company_id").collect()}
    assert set(got) == {("X", "AAA"), ("X", "TWO"), ("Y", "TWO"), ("X", "NEW"), ("X", "BAD"), ("Y", "SOLO")}  # LOST and TWO of c have no one exchange
    aaa = got["X", "AAA"]
    assert aaa.sources == ["a", "b", "c"] and aaa.company_id == "1" and aaa.resolved and aaa.conflicts == 1 and not aaa.inferred and aaa.absent == []
    assert not got["X", "BAD"].resolved and got["X", "BAD"].company_id is None and got["X", "BAD"].absent == ["a"]
    assert got["X", "NEW"].absent == ["a"] and got["X", "TWO"].absent == ["a"] and got["X", "TWO"].sources == ["a"]
    assert {k: r.company for k, r in got.items()} == {("X", "AAA"): "X:AAA", ("X", "NEW"): "X:AAA", ("X", "TWO"): "X:TWO", ("Y", "TWO"): "X:TWO", ("X", "BAD"): "X:BAD", ("Y", "SOLO"): "Y:SOLO"}
    found = listings(claims, ["company_id"], "company_id")
    assert [tuple(r) for r in reused_ids(found).collect()] == [("X", "1", ["AAA", "NEW"])]
    status = {(r.code, r.attribute): (r.status, r.value) for r in resolutions(placed(claims), ["company_id"]).where("exchange = 'X'").collect()}
    assert status["AAA", "sector"] == ("CONFLICT", None) and status["AAA", "company_id"] == ("OBSERVED", "1") and status["BAD", "company_id"] == ("CONFLICT", None)
    assert listings(claims.limit(0), ["company_id"], "company_id").collect() == []


def test_components_of_chains_hubs_and_rings(spark):
    rng = random.Random(1)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"h{i}") for i in range(50)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("self", "self"), (None, "x")]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in rng.sample(links, len(links))]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert {got[f"c{i:03}"] for i in range(71)} == {"c000"} and {got[f"h{i}"] for i in range(50)} == {"h0"} and got["hub"] == "h0"
    assert got["r3"] == "r1" and got["self"] == "self" and "x" not in got
