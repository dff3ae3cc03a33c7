import datetime as dt

from pyspark.sql import functions as F

from barwright.sources import pages

TABLE = "<table><tr><th>Code</th><th>LTP*</th><th>Vol</th></tr><tr><td> <a href='x'>ABC</a></td><td>1,234.5</td><td>-</td></tr><tr><td>D&amp;E</td><td>7</td><td>10</td></tr><tr><td colspan=3>end</td></tr></table>"


def test_tables_by_header(spark):
    df = spark.createDataFrame([(1, TABLE), (2, "<p>none</p>"), (3, None)], "page long, body string")
    got = pages.named_table(df, "body", {"code": "symbol", "ltp*": "price", "vol": "volume"}).withColumn("price", pages.number(F.col("price"))).collect()
    assert [(r.page, r.symbol, r.price, r.volume) for r in got] == [(1, "ABC", 1234.5, "-"), (1, "D&E", 7.0, "10")]


def test_depth_levels(spark):
    html = "<tr><td>Price</td><td>Qty</td></tr><tr><td>10.5</td><td>1,000</td></tr><tr><td>10.4</td><td>0</td></tr><tr><td>10.3</td></tr>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(pages.depth_levels(F.col("h")).alias("l")).collect()
    assert [tuple(x) for x in got[0].l] == [(10.5, 1000.0)] and got[1].l is None


def test_json_bodies(spark):
    df = spark.createDataFrame([(1, '{"data":[{"s":"a","p":1.5,"secret":"x"},{"s":"b"}]}'), (2, "no json"), (3, None)], "page long, body string")
    got = pages.json_rows(df, "body", "s string, p double", "data").collect()
    assert [(r.page, r.row, r.s, r.p) for r in got] == [(1, 0, "a", 1.5), (1, 1, "b", None)] and "secret" not in got[0]
    assert pages.json_rows(spark.createDataFrame([(1, '[{"s":"a"}]')], "page long, body string"), "body", "s string").count() == 1


def test_embedded_objects_by_braces(spark):
    rows = [('<script>window.S = {"a":{"b":"}\\" {"},"c":[1]}; x = {}</script>',), ("window.S = {open",), ("nothing",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "h string").select(pages.embedded_json("window.S")("h").alias("x")).collect()]
    assert got == ['{"a":{"b":"}\\" {"},"c":[1]}', None, None, None]


def test_placeholders_clocks_and_reports(spark):
    one = spark.sql("SELECT array('-', 'N/A', null) AS a, array('-', '3') AS b, CAST(null AS array<string>) AS n, '2024-01-02T10:00:00.1234567' AS t, 'Total Trades : 1,234\n  Up..: 7' AS r")
    x = one.select(
        pages.hollow(F.col("a")).alias("a"), pages.hollow(F.col("b")).alias("b"), pages.hollow(F.col("n")).alias("n"), pages.zone_candidates(F.col("t"), "Asia/Tokyo").alias("z"),
        pages.report_totals(F.col("r"), {"Total Trades": "trades", "Up": "up", "Down": "down"}).alias("r"),
    ).first()
    assert (x.a, x.b, x.n) == (True, False, True) and tuple(x.r) == (1234.0, 7.0, None)
    assert x.z.as_utc == dt.datetime(2024, 1, 2, 10, 0, 0, 123456) and x.z.as_local == dt.datetime(2024, 1, 2, 1, 0, 0, 123456)


def test_states_series_and_claims(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"symbol":"a","t":"2024-01-02T00:00:00Z","mid":1.5,"mechanisms":{"m":{"score":0.5,"phase":"ACTIVE"}}}\n')
    r = pages.load_states(spark, str(tmp_path / "s.jsonl"), ["m", "other"]).first()
    assert (r.mech_m_score, r.mech_m_phase, r.mech_other_score) == (0.5, "ACTIVE", None)
    (tmp_path / "x.json").write_text('[{"symbol":"a","t":"2024-01-02T00:00:00Z","value":1},{"symbol":"a","gap":true}]')
    assert pages.load_series(spark, str(tmp_path / "x.json")).count() == 1
    a = spark.createDataFrame([("k", "Bank", "A"), ("l", "-", None)], "id string, sector string, grade string")
    b = spark.createDataFrame([("k", "Bank", "B")], "id string, sector string, grade string")
    got = pages.spine(pages.claims({"a": a, "b": b}, "id", ["sector", "grade", "absent"])).collect()
    assert sorted((r.key, r.attribute, r.value, r.status, r.sources) for r in got) == [("k", "grade", None, "CONFLICT", 2), ("k", "sector", "Bank", "OBSERVED", 2)]
