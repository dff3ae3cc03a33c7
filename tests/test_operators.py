import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.functions import levels as L
from barwright.operators.asof import asof, nearest
from barwright.operators.mechanisms import lifecycle
from barwright.operators.sequential import cooldown
from barwright.sources import wire

T = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([("a", T(0), 1), ("a", T(10), 2), ("a", T(10), 3), ("b", T(5), 4), (None, T(5), 5)], "key string, t timestamp_ntz, id int")
    right = spark.createDataFrame([("a", T(0), 10.0), ("a", T(10), 20.0), ("a", T(30), 30.0), (None, T(4), 40.0)], "key string, t timestamp_ntz, v double")
    return left, right


@pytest.mark.parametrize("bucket", [1, 7, 10**9])
@pytest.mark.parametrize(
    ("direction", "strict", "want"),
    [
        ("backward", False, {1: 10.0, 2: 20.0, 3: 20.0, 4: None, 5: 40.0}),
        ("backward", True, {1: None, 2: 10.0, 3: 10.0, 4: None, 5: 40.0}),
        ("forward", False, {1: 10.0, 2: 20.0, 3: 20.0, 4: None, 5: None}),
        ("forward", True, {1: 20.0, 2: 30.0, 3: 30.0, 4: None, 5: None}),
    ],
)
def test_asof(sides, direction, strict, want, bucket):
    got = {r.id: r.r_v for r in asof(*sides, ["key"], "t", ["v"], direction, strict, bucket=bucket).collect()}
    assert got == want


def test_asof_leaves_null_times_without_a_match(spark, sides):
    left = spark.createDataFrame([("a", None, 1), ("a", T(11), 2)], "key string, t timestamp_ntz, id int")
    for direction, want in (("backward", 20.0), ("forward", 30.0)):
        assert {r.id: r.r_v for r in asof(left, sides[1], ["key"], "t", ["v"], direction, bucket=1).collect()} == {1: None, 2: want}


def test_asof_with_an_empty_side(sides):
    left, right = sides
    assert {r.r_v for r in asof(left, right.limit(0), ["key"], "t", ["v"]).collect()} == {None}
    assert asof(left.limit(0), right, ["key"], "t", ["v"]).collect() == []


def test_nearest_takes_the_earlier_of_equals(spark):
    left = spark.createDataFrame([("a", T(5)), ("a", T(100))], "key string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T(3), 1), ("a", T(7), 2)], "key string, t timestamp_ntz, v int")
    got = sorted(((r.r_v, r.dt) for r in nearest(left, right, ["key"], "t", ["v"], 6).collect()), key=str)
    assert got == [(1, -2.0), (None, None)]


def test_cooldown_counts_from_the_last_kept_row(spark):
    rows = [("a", float(t)) for t in (0, 5, 9, 11, 20, 22)] + [("b", 3.0)]
    got = sorted(tuple(r) for r in cooldown(spark.createDataFrame(rows, "k string, t double"), "k", "t", 10.0).collect())
    assert got == [("a", 0.0), ("a", 11.0), ("a", 22.0), ("b", 3.0)]


def test_lifecycle_hysteresis(spark):
    scores = [0.4, 0.7, 0.3, 0.3, 0.2, 0.5]
    rows = [(1, i, i * 30_000, s) for i, s in enumerate(scores)]
    got = [r.phase for r in lifecycle(spark.createDataFrame(rows, "symbol long, event_id long, sec long, m double"), ["m"]).orderBy("event_id").collect()]
    assert got == ["BUILDING", "ACTIVE", "ACTIVE", "CONFIRMED", "NONE", "BUILDING"]


def test_levels(spark):
    book = spark.sql("SELECT array(named_struct('price', 10D, 'qty', 5D), named_struct('price', 11D, 'qty', 10D)) AS a, CAST(array() AS ARRAY<STRUCT<price: DOUBLE, qty: DOUBLE>>) AS none")
    r = book.select(
        L.walk(F.col("a"), 8).alias("w"), L.walk(F.col("none"), 8).alias("w0"), L.herfindahl(F.col("a")).alias("h"), L.herfindahl(F.col("none")).alias("h0"),
        L.best(F.col("none"), "price").alias("b0"), L.difference(F.col("a"), F.col("none")).alias("d"),
    ).first()
    assert (r.w.filled, r.w.cost, r.w0.filled) == (8.0, 83.0, 0.0) and r.h == pytest.approx(125 / 225) and r.h0 is None and r.b0 is None
    assert [tuple(x) for x in r.d] == [(10.0, -5.0, "REMOVE"), (11.0, -10.0, "REMOVE")]


def test_cut_off_frames_are_reported(spark):
    frame = bytes([0, 28]) + bytes(28)
    rows = spark.createDataFrame([(1, bytearray(frame + frame[:7])), (2, bytearray(b"")), (3, None)], "stream long, body binary")
    got = sorted((r.stream, r.position, r.rest) for r in wire.read_frames(rows).collect())
    assert got == [(1, 0, None), (1, 1, 7)]
