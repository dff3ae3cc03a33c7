"""Queries over order books kept as level arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.windows import near, r6
from ..sources.tables import BOOKS, books
from .registry import query

SIDES = f"""{BOOKS}, s AS (SELECT book, side, sum(qty) AS q, sum(qty) FILTER (n <= 3) AS q3, max(qty) AS wall, sum(qty * qty) AS qq, count(*) AS k, min(price) FILTER (n = 1) AS p1, min(qty) FILTER (n = 1) AS q1 FROM ranked GROUP BY ALL),
bk AS (SELECT book, coalesce(max(q) FILTER (side = 'bid'), 0) AS bq, coalesce(max(q) FILTER (side = 'ask'), 0) AS aq, coalesce(max(q3) FILTER (side = 'bid'), 0) AS b3, coalesce(max(q3) FILTER (side = 'ask'), 0) AS a3,
  max(p1) FILTER (side = 'bid') AS bp, max(p1) FILTER (side = 'ask') AS ap, max(q1) FILTER (side = 'bid') AS bq1, max(q1) FILTER (side = 'ask') AS aq1, max(wall) FILTER (side = 'bid') AS bw, max(wall) FILTER (side = 'ask') AS aw,
  max(qq) FILTER (side = 'bid') AS bqq, max(qq) FILTER (side = 'ask') AS aqq, coalesce(max(k) FILTER (side = 'bid'), 0) AS nb, coalesce(max(k) FILTER (side = 'ask'), 0) AS na FROM s GROUP BY book)"""


def sided(spark, sf_dir):
    b = books(spark, sf_dir)
    return b.withColumn("mid", (L.best(F.col("bids"), "price") + L.best(F.col("asks"), "price")) / 2)


@query(f"""WITH {SIDES} SELECT book, nb AS n_bids, na AS n_asks, bp AS best_bid, ap AS best_ask, round(ap - bp, 6) AS spread, round((ap + bp) / 2, 6) AS mid, round((ap * bq1 + bp * aq1) / nullif(bq1 + aq1, 0), 6) AS microprice,
b3 AS bid_depth3, a3 AS ask_depth3, bq AS bid_depth, aq AS ask_depth, bw AS bid_wall, aw AS ask_wall, ap < bp AS crossed FROM bk""")
def book_stats(spark, sf_dir):
    b = sided(spark, sf_dir)
    bid, ask = F.col("bids"), F.col("asks")
    bp, ap, b1, a1 = L.best(bid, "price"), L.best(ask, "price"), L.best(bid, "qty"), L.best(ask, "qty")
    return b.select(
        "book", F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"), bp.alias("best_bid"), ap.alias("best_ask"), r6(ap - bp).alias("spread"), r6("mid").alias("mid"),
        r6(F.try_divide(ap * b1 + bp * a1, b1 + a1)).alias("microprice"), L.depth(bid, 3).alias("bid_depth3"), L.depth(ask, 3).alias("ask_depth3"), L.total(bid).alias("bid_depth"), L.total(ask).alias("ask_depth"),
        L.wall(bid).alias("bid_wall"), L.wall(ask).alias("ask_wall"), (ap < bp).alias("crossed"),
    )


@query(f"""WITH {SIDES}, g AS (SELECT r.book, r.side, sum(qty * abs(price - (bp + ap) / 2)) / sum(qty) AS c, sum(qty * exp(-5.0 * abs(price - (bp + ap) / 2) / ((bp + ap) / 2))) AS w FROM ranked r JOIN bk USING (book) WHERE bp IS NOT NULL AND ap IS NOT NULL GROUP BY ALL)
SELECT book, floor(((bq - aq) / nullif(bq + aq, 0)) * 1e6 + 0.5) / 1e6 AS imbalance, floor(((b3 - a3) / nullif(b3 + a3, 0)) * 1e6 + 0.5) / 1e6 AS imbalance3, floor(((bq - b3 - (aq - a3)) / nullif(bq - b3 + aq - a3, 0)) * 1e6 + 0.5) / 1e6 AS deep_imbalance,
  floor((bqq / nullif(bq * bq, 0)) * 1e6 + 0.5) / 1e6 AS bid_hhi, floor((aqq / nullif(aq * aq, 0)) * 1e6 + 0.5) / 1e6 AS ask_hhi, floor((bq1 / nullif(bq, 0)) * 1e6 + 0.5) / 1e6 AS bid_touch_share, floor((aq1 / nullif(aq, 0)) * 1e6 + 0.5) / 1e6 AS ask_touch_share,
  floor(((SELECT c FROM g WHERE g.book = bk.book AND side = 'bid')) * 1e6 + 0.5) / 1e6 AS bid_centroid, floor(((SELECT c FROM g WHERE g.book = bk.book AND side = 'ask')) * 1e6 + 0.5) / 1e6 AS ask_centroid,
  floor((((SELECT w FROM g WHERE g.book = bk.book AND side = 'bid') - (SELECT w FROM g WHERE g.book = bk.book AND side = 'ask')) / nullif((SELECT sum(w) FROM g WHERE g.book = bk.book), 0)) * 1e6 + 0.5) / 1e6 AS tlpi
FROM bk""")
def book_geometry(spark, sf_dir):
    """Imbalances, concentration, touch shares, centroids and the distance-decayed imbalance."""
    b = sided(spark, sf_dir)
    bid, ask, mid = F.col("bids"), F.col("asks"), F.col("mid")
    deep = lambda x: L.total(x) - L.depth(x, 3)
    both = mid.isNotNull()
    return b.select(
        "book", near(L.imbalance(L.total(bid), L.total(ask))).alias("imbalance"), near(L.imbalance(L.depth(bid, 3), L.depth(ask, 3))).alias("imbalance3"), near(L.imbalance(deep(bid), deep(ask))).alias("deep_imbalance"),
        near(L.herfindahl(bid)).alias("bid_hhi"), near(L.herfindahl(ask)).alias("ask_hhi"), near(F.try_divide(L.best(bid, "qty"), L.total(bid))).alias("bid_touch_share"), near(F.try_divide(L.best(ask, "qty"), L.total(ask))).alias("ask_touch_share"),
        near(F.when(both, L.centroid(bid, mid))).alias("bid_centroid"), near(F.when(both, L.centroid(ask, mid))).alias("ask_centroid"),
        near(F.when(both, L.imbalance(L.decayed(bid, mid, 5.0), L.decayed(ask, mid, 5.0)))).alias("tlpi"),
    )


@query(f"""WITH {BOOKS}, c AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY book ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked WHERE side = 'ask'),
t AS (SELECT book, sum(greatest(0, least(qty, 40 - before))) AS filled, sum(greatest(0, least(qty, 40 - before)) * price) AS cost, min(price) AS p1 FROM c GROUP BY book)
SELECT book, filled, round(cost / filled, 6) AS vwap, round(cost / filled / p1 - 1, 6) AS slippage FROM t""")
def walk_book(spark, sf_dir):
    """Average price of buying 40 shares, and how far above the best ask it is."""
    b = books(spark, sf_dir).where(F.size("asks") > 0).select("book", L.walk(F.col("asks"), 40).alias("w"), L.best(F.col("asks"), "price").alias("p1"))
    vwap = F.col("w.cost") / F.col("w.filled")
    return b.select("book", F.col("w.filled").alias("filled"), r6(vwap).alias("vwap"), r6(vwap / F.col("p1") - 1).alias("slippage"))


@query(f"""WITH {BOOKS}, a AS (SELECT * FROM levels WHERE side = 'ask'), b AS (SELECT * FROM levels WHERE side = 'bid'), j AS (SELECT coalesce(a.book, b.book) AS book, coalesce(a.price, b.price) AS price, a.qty AS now, b.qty AS was FROM a FULL JOIN b ON a.book = b.book AND a.price = b.price)
SELECT book, CASE WHEN was IS NULL THEN 'ADD' WHEN now IS NULL THEN 'REMOVE' WHEN now > was THEN 'INCREASE' ELSE 'REDUCE' END AS kind, count(*) AS n, sum(coalesce(now, 0) - coalesce(was, 0)) AS change FROM j WHERE coalesce(now, 0) <> coalesce(was, 0) GROUP BY ALL""")
def diff_levels(spark, sf_dir):
    """Price by price difference of two level arrays of a book, summed by kind of change."""
    d = books(spark, sf_dir).select("book", F.inline(L.difference(F.col("bids"), F.col("asks"))))
    return d.groupBy("book", "kind").agg(F.count("*").alias("n"), F.sum("change").alias("change"))


def cumulative(levels):
    return F.transform(levels, lambda x, i: F.struct((i + 1).cast("long").alias("level"), x["price"].alias("price"), x["qty"].alias("qty"), r6(L.total(F.slice(levels, F.lit(1), i + 1))).alias("cumulative")))


@query(f"WITH {BOOKS} SELECT book, side, n::BIGINT AS level, price, qty, round(sum(qty) OVER (PARTITION BY book, side ORDER BY n ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM ranked")
def explode_levels(spark, sf_dir):
    """Level arrays as rows with cumulative depth, in one pass over each array."""
    b = books(spark, sf_dir)
    rows = None
    for side in ("bid", "ask"):
        part = b.select("book", F.lit(side).alias("side"), F.inline(cumulative(F.col(side + "s"))))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(f"""WITH {BOOKS}, x AS (SELECT book, side, n - 1 AS d, ln(1 + qty) AS y FROM ranked) SELECT book, side, count(*) AS n, round(regr_slope(y, d), 6) AS slope, round(regr_intercept(y, d), 6) AS intercept FROM x GROUP BY ALL HAVING count(*) >= 2""")
def ladder_fit(spark, sf_dir):
    """Log-linear fit of quantity on depth per side."""
    b = books(spark, sf_dir)
    x = b.select("book", F.lit("bid").alias("side"), F.posexplode("bids").alias("d", "l")).unionByName(b.select("book", F.lit("ask").alias("side"), F.posexplode("asks").alias("d", "l")))
    x = x.select("book", "side", F.col("d").cast("double").alias("d"), F.log1p("l.qty").alias("y"))
    return x.groupBy("book", "side").agg(F.count("*").alias("n"), r6(F.regr_slope("y", "d")).alias("slope"), r6(F.regr_intercept("y", "d")).alias("intercept")).where("n >= 2")


@query(f"""WITH {BOOKS}, p AS (SELECT book, side, sum(qty / n) AS w, stddev_pop(qty) / avg(qty) AS cv FROM ranked GROUP BY ALL), q AS (SELECT book, coalesce(max(w) FILTER (side = 'bid'), 0) AS b, coalesce(max(w) FILTER (side = 'ask'), 0) AS a FROM p GROUP BY book)
SELECT book, round(b, 6) AS bid_pressure, round(a, 6) AS ask_pressure, round(1 / (1 + exp(-3 * (b - a) / nullif(b + a, 0))), 6) AS buy_probability FROM q""")
def infer_pressure(spark, sf_dir):
    """Rank-decayed depth of both sides and a logistic reading of their difference."""
    w = lambda c: F.aggregate(F.transform(c, lambda x, i: x["qty"] / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    b = books(spark, sf_dir).select("book", w(F.col("bids")).alias("b"), w(F.col("asks")).alias("a"))
    return b.select("book", r6("b").alias("bid_pressure"), r6("a").alias("ask_pressure"), r6(1 / (1 + F.exp(-3 * L.imbalance(F.col("b"), F.col("a"))))).alias("buy_probability"))
