import datetime as dt

import pytest

from barwright.operators import guards
from barwright.sources import files


def test_bars_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' Symbol ,DATE,Close,Volume,extra\nx,2024-01-02,"1,010.5",7,q\n,2024-01-02,1,1,q\ny,not a day,1,1,q\nz,2024-01-03,-,,q\n')
    got = files.read_bars_csv(spark, str(tmp_path), {"Date": "ts"}).collect()
    assert sorted((r.symbol, r.ts, r.close, r.volume, r.open) for r in got) == [("x", dt.date(2024, 1, 2), 1010.5, 7.0, None), ("z", dt.date(2024, 1, 3), None, None, None)]
    with pytest.raises(ValueError, match="ts"):
        files.read_bars_csv(spark, str(tmp_path))


def test_symbols_from_file_names(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("ts,open,high,low,close,volume\n2024-01-02,1,2,1,2,5\n")
    (tmp_path / "DEF.csv").write_text("ts,open,high,low,close,volume\n2024-01-02,3,4,3,x,5\n")
    got = files.read_symbol_folder(spark, str(tmp_path)).collect()
    assert sorted((r.symbol, r.open, r.close) for r in got) == [("ABC", 1.0, 2.0), ("DEF", 3.0, None)]


def test_minutes_to_days(spark):
    t = lambda h: dt.datetime(2024, 1, 2, h)
    rows = [("a", t(11), 2.0, 3.0, 2.0, 2.5, 1.0), ("a", t(10), 1.0, 2.0, 0.5, 2.0, 4.0), (None, t(10), 1.0, 1.0, 1.0, 1.0, 1.0)]
    day = files.minute_panel(spark.createDataFrame(rows, "symbol string, t timestamp_ntz, open double, high double, low double, close double, volume double")).collect()
    assert [(r.symbol, r.open, r.high, r.low, r.close, r.volume, r.minutes, r.first_minute) for r in day] == [("a", 1.0, 3.0, 0.5, 2.5, 5.0, 2, t(10))]


def test_empty_results_never_overwrite(spark, tmp_path):
    path = f"{tmp_path}/t"
    some = spark.sql("SELECT 1 AS a, array(named_struct('p', 1)) AS l")
    assert files.write_table(some, path) and not files.write_table(some.limit(0), path)
    assert spark.read.parquet(path).count() == 1
    cover = files.extract(spark, {"x": some, "y": some.limit(0)}, f"{tmp_path}/out").collect()
    assert [(r.table, r.n_rows, r.written) for r in cover] == [("x", 1, True), ("y", 0, False)]
    assert spark.read.csv(f"{tmp_path}/out/x", header=True).first().l == '[{"p":1}]'


def test_guards(spark):
    one = spark.sql("SELECT * FROM VALUES (1, 'P', 2.0), (2, NULL, 3.0) AS t(k, panel, y_out)")
    assert guards.assert_single_panel(one) is one
    with pytest.raises(ValueError, match="mix panels"):
        guards.assert_single_panel(one.union(spark.sql("SELECT 3, 'Q', 1.0")))
    assert guards.input_columns(one, ["k"], ["y_out"]) == ["panel"]
    guards.assert_pit(["panel"], ["y_out"])
    for bad in (["y_out"], ["fwd_ret"], ["seen"]):
        with pytest.raises(ValueError, match="not known"):
            guards.assert_pit(bad, ["y_out"], ["seen"])
    guards.guard_forbidden_keys({"a": [{"b": 1}]}, ["c"])
    with pytest.raises(ValueError, match=r"a\.0\.b"):
        guards.guard_forbidden_keys({"a": [{"b": 1}]}, ["b"])
    ledger = spark.createDataFrame([("d1", "OPEN"), ("d2", "SEALED")], "day string, status string")
    assert guards.check_sessions(ledger.where("day = 'd1'"), ledger).count() == 1
    with pytest.raises(ValueError, match="d2"):
        guards.check_sessions(ledger, ledger)
