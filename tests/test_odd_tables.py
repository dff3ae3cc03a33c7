"""Queries against their SQL on small tables with odd rows: what the given tables hold rarely or not at all."""

import datetime as dt
import math
import os

import duckdb
import pandas as pd
import pytest

from barwright.plans.registry import ORACLES, QUERIES

DAY = dt.datetime(1996, 1, 1)
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ORDER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
EVENT = ("event_id", "ts", "user_id", "event_type", "value", "props")


def line(order, number, price, flag="N", supplier=0, day=0, quantity=1.0):
    return (order, 0, supplier, number, quantity, price * quantity, 0.0, 0.0, flag, "O", DAY + dt.timedelta(days=day))


def order(key, customer, day):
    return (key, customer, "O", 1.0, DAY + dt.timedelta(days=day), "5-LOW")


def event(key, user, seconds, value, kind="view", k=5):
    return (key, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds), user, kind, value, f'{{"k": {k}}}')


def exact(rows):
    plain = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


def write(folder, **tables):
    """The tables as Parquet in the folder, and a connection that sees them."""
    con = duckdb.connect()
    for table, rows in tables.items():
        columns = {"lineitem": LINE, "orders": ORDER, "events": EVENT, "supplier": ("s_suppkey", "s_nationkey")}[table]
        frame = pd.DataFrame(rows, columns=columns)  # noqa: F841  read by the next line
        con.execute(f"COPY (SELECT {', '.join(f'{c}::TIMESTAMP AS {c}' if c in ('ts', 'l_shipdate', 'o_orderdate') else c for c in columns)} FROM frame) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def against_sql(spark, folder, name, **tables):
    """Spark's rows, after a comparison with the SQL's to the last digit."""
    con = write(folder, **tables)
    df = QUERIES[name](spark, os.fspath(folder))
    got = exact(df.collect())
    assert got == exact(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()) and got
    return got


def test_returns_over_a_mid_of_zero(spark, tmp_path):
    mids = {0: [50, 150, 50, 50, 50], 1: [50, 50, 50, 50, 950], 2: [120, 240, 360, 480, 600]}
    books = [(10 * c + i, c, p) for c, prices in mids.items() for i, p in enumerate(prices)]
    got = against_sql(spark, tmp_path, "frame_outcomes", lineitem=[line(b, n, p, flag) for b, _, p in books for n, flag in ((1, "N"), (2, "R"))], orders=[order(b, c, b) for b, c, _ in books])
    returns = {r[1]: r[2:] for r in got}
    assert returns[0] == ("nan", math.inf, "nan") and returns[11] == (math.inf, math.inf, "nan") and returns[20] == (3.0, 3.0, 1.0) and returns[14] == (None, None, None)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_fits_over_windows_that_end_at_a_row_and_times_seconds_apart(spark, tmp_path, batch):
    ten = 10 * 86400
    # Ten days and one of these numbers of seconds apart are more than ten days in fractions of a day; others come close together or at once.
    times = {1: [77, 77 + 8193, 100_000, 77 + ten, 8270 + ten, 100_000 + ten, 100_001 + ten], 2: [0, 1, 2, 4, 11, 12, 12, 12, 13], 3: [ten * k + 7 for k in range(8)], 4: [5], 5: [3, 3, 3], 6: [1000, 1000 + ten, 1001 + ten, 2 * ten + 1001]}
    times[7] = [37_003 * k for k in range(60)] + [ten + 37_003 * k for k in range(30)]
    events = [event(100 * u + i, u, s, round(10 + 3.7 * ((i * 7919) % 13) + 0.01 * u, 2)) for u, at in times.items() for i, s in enumerate(sorted(at))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r[1]: r for r in against_sql(spark, tmp_path, "irregular_fits", events=events)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[307][2] == 2 and got[103][2] == 4 and got[202][3] is not None and got[502][2:] == (3, None, None, None)


def test_moves_equal_to_their_ninth_decile(spark, tmp_path):
    # In doubles these last moves are above and below the decile by a digit of the interpolation; others lie beside plain values.
    paths = {1: [127.14, 135.79, 26.45, 0.49, 194.83, 363.67], 2: [87.42, 35.05, 126.12, 84.24, 64.82, 144.28], 3: [5.0] * 9, 4: [0.0, 1.0, 3.0, 6.0], 5: [0.1 * (i % 5) for i in range(40)]}
    got = against_sql(spark, tmp_path, "velocity_decile", events=[event(100 * u + i, u, 3600 * i, v) for u, p in paths.items() for i, v in enumerate(p)])
    fast = {r[1]: r[3] for r in got}
    assert fast[105] and not fast[205] and fast[308] and not fast[403]


def test_queues_that_begin_with_several_snapshots_of_a_day(spark, tmp_path):
    # A best bid of 500 whose first day has three snapshots: the queue begins with the one of the smallest order. The SQL leaves their
    # order open and takes this one in tables as small as the first.
    def tables(customers):
        days = [(c, 100 * c + i, day, quantity) for c in range(customers) for i, (day, quantity) in enumerate([(0, 9.0), (0, 3.0), (0, 20.0), (30, 12.0)])]
        return {"lineitem": [x for _, key, _, q in days for x in (line(key, 2, 900, "N", quantity=5.0), line(key, 1, 500, "A", quantity=q))][::-1], "orders": [order(key, c, day) for c, key, day, _ in days][::-1]}

    for customers in (3, 500):
        (folder := tmp_path / str(customers)).mkdir()
        if customers == 3:
            got = against_sql(spark, folder, "queue_pull_stack", **tables(customers))
        else:
            write(folder, **tables(customers))
            got = QUERIES["queue_pull_stack"](spark, os.fspath(folder)).collect()
        assert {(r[1] % 100, r[3]) for r in got} == {(0, 0.0), (1, 0.0), (2, 0.55), (3, 0.25)}
