"""Market tables shaped from the star schema: bars, tape, quotes and order books, each with its SQL twin.

A bar is one supplier's line items of one ship day: price is extended price over quantity, open and close are those of
the first and last line item by (order, line), volume is the quantity. A tape is an event stream with running totals. A
book is an order's line items: returned or accepted ones bid, the others ask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """(symbol, ts date, open, high, low, close, volume, turnover, trades), unique by (symbol, ts).

    ``together``: line items are dealt out by symbol, so that what follows by symbol needs no further shuffle.
    """
    price = F.try_divide("l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ts"), price.alias("price"), "l_quantity", "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", price.alias("price")).alias("at"),
    )
    return (rows.repartition("symbol") if together else rows).groupBy("symbol", "ts").agg(
        F.min("at")["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max("at")["price"].alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 4).alias("turnover"), F.count("*").alias("trades"),
    )


BARS = """bars AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, list(p ORDER BY l_orderkey, l_linenumber, p)[1] AS open, max(p) AS high, min(p) AS low,
    list(p ORDER BY l_orderkey, l_linenumber, p)[-1] AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 4) AS turnover, count(*) AS trades
  FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS p FROM lineitem) GROUP BY ALL)"""


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, t timestamp, event_id, source, value, k): events as prints, ``k`` from the JSON properties."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol"), F.col("ts").alias("t"), "event_id", F.col("event_type").alias("source"), "value",
        F.from_json("props", "k INT")["k"].alias("k"),
    )


TAPE = """tape AS (SELECT user_id AS symbol, ts AS t, event_id, event_type AS source, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, symbol, bids, asks): levels array<struct<price double, qty double>>, best first.

    Prices are cut to whole units; one level per price, quantities summed; a side without line items is an empty array.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book"), F.when(F.col("l_returnflag") == "N", "ask").otherwise("bid").alias("side"),
        F.floor(F.try_divide("l_extendedprice", "l_quantity")).cast("double").alias("price"), F.col("l_quantity").alias("qty"),
    )
    levels = rows.groupBy("book", "side", "price").agg(F.sum("qty").alias("qty"))
    level = F.struct("price", "qty")
    both = levels.groupBy("book").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level))).alias("asks"),
    )
    return both


BOOKS = """levels AS (
  SELECT l_orderkey AS book, CASE WHEN l_returnflag = 'N' THEN 'ask' ELSE 'bid' END AS side, floor(l_extendedprice / nullif(l_quantity, 0)) AS price, sum(l_quantity) AS qty
  FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS n FROM levels)"""


#: Width of a price step of the snapshots.
STEP = 100


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, book, dn, vol, bids, asks): a customer's orders as snapshots of one book over time.

    Levels are as in ``books`` with prices cut to steps of ``STEP``; ``dn`` counts days since 1970, ``vol`` is what was traded
    since the snapshot before (returned quantities). Snapshots of a symbol are in the order of (dn, book).
    """
    price = F.floor(F.try_divide("l_extendedprice", "l_quantity") / STEP) * F.lit(float(STEP))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book"), F.when(F.col("l_returnflag") == "N", "ask").otherwise("bid").alias("side"), price.alias("price"), F.col("l_quantity").alias("qty"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("vol"),
    )
    levels = rows.groupBy("book", "side", "price").agg(F.sum("qty").alias("qty"), F.sum("vol").alias("vol"))
    level = F.struct("price", "qty")
    both = levels.groupBy("book").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level))).alias("asks"), F.sum("vol").alias("vol"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), F.col("o_custkey").alias("symbol"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).alias("dn"))
    return both.join(orders, "book").select("symbol", "book", "dn", "vol", "bids", "asks")


SNAPSHOTS = f"""levels AS (
  SELECT l_orderkey AS book, CASE WHEN l_returnflag = 'N' THEN 'ask' ELSE 'bid' END AS side, floor(l_extendedprice / nullif(l_quantity, 0) / {STEP}) * {STEP} AS price, sum(l_quantity) AS qty,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS vol FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS n FROM levels),
snaps AS (SELECT o_custkey AS symbol, o_orderkey AS book, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INT) AS dn, v.vol FROM orders JOIN (SELECT book, sum(vol) AS vol FROM levels GROUP BY book) v ON v.book = o_orderkey)"""

#: Of each snapshot best prices and quantities (b1, bq, a1, aq), total and three-level depth (bd, ad, b3, a3), levels (nb, na), the
#: largest level's quantity and price (bw, bwp, aw, awp).
TOUCH = ("b1", "bq", "bd", "b3", "nb", "bw", "bwp", "a1", "aq", "ad", "a3", "na", "aw", "awp")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, book, dn, vol, ``TOUCH``): one row a snapshot; values of an empty side are null, its depths 0."""
    out = snapshots(spark, sf_dir)
    for x, side in (("b", "bids"), ("a", "asks")):
        top, sum_ = F.get(side, F.lit(0)), lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v["qty"])
        wall = F.array_max(F.transform(side, lambda v, i: F.struct(v["qty"].alias("qty"), (-i).alias("i"), v["price"].alias("price"))))
        out = out.withColumns({f"{x}1": top["price"], f"{x}q": top["qty"], f"{x}d": sum_(F.col(side)), f"{x}3": sum_(F.slice(side, 1, 3)), f"n{x}": F.size(side).cast("long"), f"{x}w": wall["qty"], f"{x}wp": wall["price"]})
    return out.select("symbol", "book", "dn", "vol", *TOUCH)


def _touch_sql() -> str:
    parts = []
    for x, side in (("b", "bid"), ("a", "ask")):
        own = f"FILTER (side = '{side}')"
        parts += [
            f"max(price) FILTER (side = '{side}' AND n = 1) AS {x}1", f"max(qty) FILTER (side = '{side}' AND n = 1) AS {x}q", f"coalesce(sum(qty) {own}, 0) AS {x}d",
            f"coalesce(sum(qty) FILTER (side = '{side}' AND n <= 3), 0) AS {x}3", f"count(*) {own} AS n{x}", f"max(qty) {own} AS {x}w",
            f"(list(price ORDER BY qty DESC, n) {own})[1] AS {x}wp",
        ]
    return f"touches AS (SELECT s.symbol, s.book, s.dn, s.vol, {', '.join(parts)} FROM snaps s JOIN ranked r USING (book) GROUP BY ALL)"


TOUCHES = f"{SNAPSHOTS}, {_touch_sql()}"
