"""Queries over book snapshots in time: reconstruction, touch events, episodes, queue state and its mechanisms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.windows import near, near_sql
from ..operators.mechanisms import ramp
from ..sources.tables import SNAPSHOTS, STEP, TOUCHES, snapshots, touches
from .registry import query

W = "OVER (PARTITION BY symbol ORDER BY dn, book)"
PAST = "OVER (PARTITION BY symbol ORDER BY dn, book ROWS BETWEEN {} PRECEDING AND {})"


def in_order() -> Window:
    return Window.partitionBy("symbol").orderBy("dn", "book")


CHANGES = f"""{SNAPSHOTS}, p AS (SELECT *, lag(book) {W} AS prev FROM snaps),
x AS (SELECT p.book, side, price, qty AS q FROM p JOIN levels USING (book) WHERE prev IS NOT NULL UNION ALL SELECT p.book, side, price, -qty FROM p JOIN levels l ON l.book = p.prev),
d AS (SELECT book, side, price, sum(q) AS ch FROM x GROUP BY ALL HAVING sum(q) <> 0),
a AS (SELECT book, count(*) AS n, sum(greatest(ch, 0)) AS added, sum(greatest(-ch, 0)) AS removed FROM d GROUP BY book),
c AS (SELECT p.*, CASE WHEN prev IS NOT NULL THEN coalesce(n, 0) END AS n, CASE WHEN prev IS NOT NULL THEN coalesce(added, 0) END AS added, CASE WHEN prev IS NOT NULL THEN coalesce(removed, 0) END AS removed FROM p LEFT JOIN a USING (book))"""


def changes(spark, sf_dir):
    """(symbol, book, dn, n, added, removed): price by price against the symbol's snapshot before; null for its first."""
    w = in_order()
    s = snapshots(spark, sf_dir)
    s = s.select("symbol", "book", "dn", "bids", "asks", F.lag("bids").over(w).alias("b0"), F.lag("asks").over(w).alias("a0"))
    d = s.select("symbol", "book", "dn", F.concat(L.difference(F.col("b0"), F.col("bids")), L.difference(F.col("a0"), F.col("asks"))).alias("d"))
    total = lambda f: F.aggregate("d", F.lit(0.0), lambda acc, x: acc + F.greatest(f(x["change"]), F.lit(0.0)))
    return d.select("symbol", "book", "dn", F.when(F.col("d").isNotNull(), F.size("d")).cast("long").alias("n"), total(lambda c: c).alias("added"), total(lambda c: -c).alias("removed"))


@query(f"""WITH {CHANGES}, i AS (SELECT *, sum((coalesce(n, 1) > 0)::INT) {W} AS island FROM c) SELECT symbol, book, n::BIGINT AS changed_levels, added, removed, row_number() OVER (PARTITION BY symbol, island ORDER BY dn, book) - 1 AS unchanged_run FROM i""")
def reconstruct_books(spark, sf_dir):
    """Each snapshot against the one before: levels that changed, quantity added and removed, length of an unchanged run."""
    i = changes(spark, sf_dir).withColumn("island", F.sum((F.coalesce("n", F.lit(1)) > 0).cast("int")).over(in_order()))
    run = F.row_number().over(Window.partitionBy("symbol", "island").orderBy("dn", "book")) - 1
    return i.select("symbol", "book", F.col("n").alias("changed_levels"), "added", "removed", run.cast("long").alias("unchanged_run"))


@query(f"""WITH {CHANGES}, v AS (SELECT symbol, book, sum(coalesce(added, 0) + coalesce(removed, 0)) OVER (PARTITION BY symbol ORDER BY dn RANGE BETWEEN 365 PRECEDING AND CURRENT ROW) AS moved, dn - min(dn) OVER (PARTITION BY symbol) AS age FROM c) SELECT symbol, book, {near_sql('moved / greatest(least(365, age), 1)')} AS velocity FROM v""")
def book_velocity(spark, sf_dir):
    """Quantity moved a day over the last year, or over the symbol's age where that is shorter."""
    year = Window.partitionBy("symbol").orderBy("dn").rangeBetween(-365, 0)
    moved = F.sum(F.coalesce("added", F.lit(0.0)) + F.coalesce("removed", F.lit(0.0))).over(year)
    age = F.col("dn") - F.min("dn").over(Window.partitionBy("symbol"))
    return changes(spark, sf_dir).select("symbol", "book", near(moved / F.greatest(F.least(F.lit(365), age), F.lit(1))).alias("velocity"))


@query(f"""WITH {SNAPSHOTS}, r AS (SELECT *, row_number() {W} AS rn FROM snaps), l AS (SELECT symbol, side, price, dn, rn, qty, rn - row_number() OVER (PARTITION BY symbol, side, price ORDER BY rn) AS island FROM r JOIN levels USING (book))
SELECT symbol, side, price, min(rn) AS first_snapshot, count(*) AS snapshots, (max(dn) - min(dn))::BIGINT AS days, min(qty) AS least_qty FROM l GROUP BY symbol, side, price, island""")
def level_persistence(spark, sf_dir):
    """Lives of levels: stretches of a symbol's consecutive snapshots that show a price on a side."""
    r = snapshots(spark, sf_dir).withColumn("rn", F.row_number().over(in_order()))
    rows = None
    for side in ("bid", "ask"):
        part = r.select("symbol", "dn", "rn", F.lit(side).alias("side"), F.inline(side + "s"))
        rows = part if rows is None else rows.unionByName(part)
    own = Window.partitionBy("symbol", "side", "price").orderBy("rn")
    lives = rows.withColumn("island", F.col("rn") - F.row_number().over(own)).groupBy("symbol", "side", "price", "island")
    return lives.agg(F.min("rn").cast("long").alias("first_snapshot"), F.count("*").alias("snapshots"), (F.max("dn") - F.min("dn")).cast("long").alias("days"), F.min("qty").alias("least_qty")).drop("island")


WALLS = f"w AS (SELECT *, bwp - lag(bwp) {W} AS moved, aw / nullif(ad, 0) AS share FROM touches), i AS (SELECT *, sum((coalesce(moved, 1) <> 0)::INT) {W} AS island FROM w)"


@query(f"WITH {TOUCHES}, {WALLS} SELECT symbol, book, bw AS bid_wall, bwp AS bid_wall_price, moved / {STEP} AS bid_wall_steps, row_number() OVER (PARTITION BY symbol, island ORDER BY dn, book) AS held, {near_sql('share')} AS ask_wall_share FROM i")
def wall_track(spark, sf_dir):
    """The largest bid level over time: steps it moved, snapshots it has stood at its price; the ask wall's share."""
    w = touches(spark, sf_dir).withColumn("moved", F.col("bwp") - F.lag("bwp").over(in_order()))
    i = w.withColumn("island", F.sum((F.coalesce("moved", F.lit(1.0)) != 0).cast("int")).over(in_order()))
    held = F.row_number().over(Window.partitionBy("symbol", "island").orderBy("dn", "book")).cast("long")
    return i.select("symbol", "book", F.col("bw").alias("bid_wall"), F.col("bwp").alias("bid_wall_price"), (F.col("moved") / STEP).alias("bid_wall_steps"), held.alias("held"), near(F.try_divide("aw", "ad")).alias("ask_wall_share"))


#: What happened to the best bid since the snapshot before; ``gone`` is the quantity that left the old best price.
KIND = "CASE WHEN p0 IS NULL OR b1 IS NULL THEN 'NONE' WHEN b1 > p0 THEN 'IMPROVE' WHEN b1 < p0 THEN 'RETREAT' WHEN bq > q0 THEN 'STACK' WHEN bq < q0 THEN 'DROP' ELSE 'SAME' END"
GONE = "CASE WHEN b1 < p0 THEN q0 WHEN b1 = p0 AND bq < q0 THEN q0 - bq ELSE 0.0 END"
EVENTS = f"e AS (SELECT *, lag(b1) {W} AS p0, lag(bq) {W} AS q0, lag(a1) {W} AS o0 FROM touches), k AS (SELECT *, {KIND} AS kind, coalesce({GONE}, 0.0) AS gone FROM e), t AS (SELECT *, least(gone, vol) AS traded, gone - least(gone, vol) AS pulled FROM k)"


def touch_rows(spark, sf_dir):
    e = touches(spark, sf_dir).selectExpr("*", f"lag(b1) {W} AS p0", f"lag(bq) {W} AS q0", f"lag(a1) {W} AS o0")
    k = e.withColumn("kind", F.expr(KIND)).withColumn("gone", F.coalesce(F.expr(GONE), F.lit(0.0)))
    return k.withColumn("traded", F.least("gone", "vol")).withColumn("pulled", F.col("gone") - F.col("traded"))


@query(f"WITH {TOUCHES}, {EVENTS} SELECT symbol, book, kind, gone, traded, pulled FROM t")
def touch_events(spark, sf_dir):
    """Changes of the best bid; what left it is traded up to the volume of the interval, and pulled beyond."""
    return touch_rows(spark, sf_dir).select("symbol", "book", "kind", "gone", "traded", "pulled")


@query(f"""WITH {TOUCHES}, r AS (SELECT *, lag(bd) {W} AS t0, row_number() {W} AS rn FROM touches), d AS (SELECT * FROM r WHERE bd <= 0.5 * t0),
n AS (SELECT d.symbol, d.book, min(r.rn) - min(d.rn) AS after, any_value(d.t0) AS t0 FROM d LEFT JOIN r ON r.symbol = d.symbol AND r.rn > d.rn AND r.rn <= d.rn + 6 AND r.dn <= d.dn + 365 AND r.bd >= 0.8 * d.t0 GROUP BY d.symbol, d.book)
SELECT symbol, book, t0 AS depth_before, after::BIGINT AS replenished_after FROM n""")
def depletion_episodes(spark, sf_dir):
    """Bid depth that halves, and after how many snapshots (six and a year at most) four fifths of it are back."""
    w = in_order()
    ahead = F.collect_list(F.struct("bd", "dn")).over(w.rowsBetween(1, 6))
    r = touches(spark, sf_dir).select("symbol", "book", "dn", "bd", F.lag("bd").over(w).alias("t0"), ahead.alias("ahead")).where("bd <= 0.5 * t0")
    back = F.transform("ahead", lambda x, i: F.when((x["bd"] >= 0.8 * F.col("t0")) & (x["dn"] <= F.col("dn") + 365), i + 1))
    return r.select("symbol", "book", F.col("t0").alias("depth_before"), F.array_min(back).cast("long").alias("replenished_after"))


@query(f"WITH {TOUCHES} SELECT t.symbol, t.book, coalesce(sum(qty) FILTER (r.price > t.b1 - 2 * {STEP}), 0) AS ahead, coalesce(sum(qty) FILTER (r.price = t.b1 - 2 * {STEP}), 0) AS beside FROM touches t JOIN ranked r ON r.book = t.book AND r.side = 'bid' GROUP BY ALL")
def queue_position(spark, sf_dir):
    """Bid quantity ahead of an order two steps below the best price, and beside it."""
    s = snapshots(spark, sf_dir).where(F.size("bids") > 0)
    price = L.best(F.col("bids"), "price") - 2 * STEP
    return s.select("symbol", "book", L.total(F.filter("bids", lambda x: x["price"] > price)).alias("ahead"), L.total(F.filter("bids", lambda x: x["price"] == price)).alias("beside"))


VACUUM = "v AS (SELECT *, quantile_cont(bd, 0.5) {p} AS bm, quantile_cont(ad, 0.5) {p} AS am, count(*) {p} AS k FROM touches)".format(p=PAST.format(10, "1 PRECEDING"))


@query(f"WITH {TOUCHES}, {VACUUM} SELECT symbol, book, k >= 5 AND bd < 0.5 * bm AND ad < 0.5 * am AS vacuum, {near_sql('bd / nullif(bm, 0)')} AS bid_share FROM v")
def book_vacuum(spark, sf_dir):
    """Both sides below half of the median of the ten snapshots before."""
    w = in_order().rowsBetween(-10, -1)
    v = touches(spark, sf_dir).select("symbol", "book", "bd", "ad", F.percentile("bd", 0.5).over(w).alias("bm"), F.percentile("ad", 0.5).over(w).alias("am"), F.count("*").over(w).alias("k"))
    return v.select("symbol", "book", F.expr("k >= 5 AND bd < 0.5 * bm AND ad < 0.5 * am").alias("vacuum"), near(F.try_divide("bd", "bm")).alias("bid_share"))


SIX = PAST.format(5, "CURRENT ROW")
#: Shares and counts over the last six snapshots; the text runs on both engines.
QUEUE = {
    "n": f"count(*) {SIX}", "traded6": f"sum(traded) {SIX}", "pulled6": f"sum(pulled) {SIX}", "vol6": f"sum(vol) {SIX}",
    "stacks": f"sum(CASE WHEN kind = 'STACK' THEN 1 ELSE 0 END) {SIX}", "retreats": f"sum(CASE WHEN kind = 'RETREAT' THEN 1 ELSE 0 END) {SIX}",
    "improves": f"sum(CASE WHEN kind = 'IMPROVE' THEN 1 ELSE 0 END) {SIX}", "turns": f"sum(CASE WHEN kind IN ('IMPROVE', 'RETREAT') THEN 1 ELSE 0 END) {SIX}",
    "drift": f"abs(b1 - first_value(b1) {SIX}) / {STEP}", "bid6": f"sum(bd) {SIX}", "ask6": f"sum(ad) {SIX}", "deep": "(bd - b3) / nullif(bd, 0)", "deep_ask": "(ad - a3) / nullif(ad, 0)",
    "low": f"min(bd + ad) {SIX}", "high": f"max(bd + ad) {SIX}", "spread": f"(a1 - b1) / {STEP}", "together": f"sum(CASE WHEN b1 > p0 AND a1 > o0 OR b1 < p0 AND a1 < o0 THEN 1 ELSE 0 END) {SIX}",
    "wall6": f"sum(CASE WHEN bw >= 0.5 * bd AND bd > 0 THEN 1 ELSE 0 END) {SIX}",
}
SHARE = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
QUEUE_MECHANISMS = {
    "queue_pull_stack": f"{ramp(SHARE('pulled6', 'pulled6 + traded6'), 0.2, 0.8)} * {ramp(SHARE('stacks', 'n'), 0.0, 0.4)}",
    "quote_refresh_churn": f"{ramp(SHARE('turns', 'n'), 0.4, 0.9)} * (1 - {ramp('drift', 1.0, 4.0)})",
    "pegged_repricing": f"{ramp(SHARE('together', 'n'), 0.2, 0.7)}",
    "adverse_retreat": f"{ramp(SHARE('retreats', 'n'), 0.2, 0.6)} * {ramp(SHARE('pulled6', 'pulled6 + traded6'), 0.3, 0.9)}",
    "liquidity_vacuum": f"1 - {ramp(SHARE('(bd + ad) * n', 'bid6 + ask6'), 0.1, 0.6)}",
    "vacuum_snapback": f"{ramp(SHARE('bd + ad', 'low'), 3.0, 12.0)} * {ramp(SHARE('bd + ad', 'high'), 0.6, 1.0)}",
    "book_trade_divergence": f"{ramp(SHARE('bid6 - ask6', 'bid6 + ask6'), 0.0, 0.6)} * {ramp(SHARE('traded6', 'vol6'), 0.1, 0.6)}",
    "depth_price_divergence": f"CASE WHEN b1 < p0 THEN 1.0 ELSE 0.0 END * {ramp(SHARE('bd * n', 'bid6'), 1.0, 2.0)}",
    "layering_like": f"{ramp('deep', 0.1, 0.5)} * {ramp(SHARE('pulled6', 'pulled6 + traded6'), 0.3, 0.9)}",
    "hidden_replenishment": f"{ramp(SHARE('traded6', 'bid6'), 0.1, 0.5)} * {ramp(SHARE('bd * n', 'bid6'), 0.7, 1.2)}",
    "liquidity_depletion": f"1 - {ramp(SHARE('bd * n', 'bid6'), 0.2, 0.8)}",
    "resilience_asymmetry": f"{ramp(f'abs({SHARE('bd * n', 'bid6')} - {SHARE('ad * n', 'ask6')})', 0.5, 2.0)}",
    "trap_pressure": f"{ramp(SHARE('improves', 'n'), 0.2, 0.6)} * {ramp(SHARE('ask6 - bid6', 'bid6 + ask6'), 0.0, 0.6)}",
    "deep_book_shape": f"{ramp('abs(coalesce(deep, 0) - coalesce(deep_ask, 0))', 0.1, 0.5)}",
}
QUEUE_SQL = f"{TOUCHES}, {EVENTS}, q AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in QUEUE.items())} FROM t)"


def queue_features(spark, sf_dir):
    return touch_rows(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in QUEUE.items()])


@query(f"WITH {QUEUE_SQL} SELECT symbol, book, n, {near_sql(SHARE('pulled6', 'pulled6 + traded6'))} AS pulled_share, {near_sql(SHARE('retreats', 'n'))} AS retreat_share, {near_sql(SHARE('turns', 'n'))} AS churn, {near_sql('drift')} AS drift FROM q")
def queue_state(spark, sf_dir):
    """Shares of the last six snapshots: pulled of all that left the touch, retreats, turns of the best price, its drift."""
    q = queue_features(spark, sf_dir)
    e = lambda a, b: near(F.expr(SHARE(a, b)))
    return q.select("symbol", "book", "n", e("pulled6", "pulled6 + traded6").alias("pulled_share"), e("retreats", "n").alias("retreat_share"), e("turns", "n").alias("churn"), near("drift").alias("drift"))


@query(f"WITH {QUEUE_SQL} SELECT symbol, book, {', '.join(f'{near_sql(e)} AS {n}' for n, e in QUEUE_MECHANISMS.items())} FROM q")
def queue_mechanisms(spark, sf_dir):
    """Scores of the mechanisms that show in the book itself, from one pass of windows over a symbol's snapshots."""
    return queue_features(spark, sf_dir).select("symbol", "book", *[near(F.expr(e)).alias(n) for n, e in QUEUE_MECHANISMS.items()])


SHAPES = f"""{SNAPSHOTS}, g AS (SELECT book, max(price) FILTER (side = 'bid' AND n = 1) AS b1, min(price) FILTER (side = 'ask' AND n = 1) AS a1 FROM ranked GROUP BY book),
z AS (SELECT r.*, row_number() OVER (PARTITION BY book, side ORDER BY qty DESC, n) AS big FROM ranked r),
f AS (SELECT book, coalesce(sum(qty) FILTER (side = 'bid' AND big > 1 AND n <= 5), 0) AS bf, coalesce(sum(qty) FILTER (side = 'ask' AND big > 1 AND n <= 5), 0) AS af, coalesce(sum(qty / n) FILTER (side = 'bid'), 0) AS br, coalesce(sum(qty / n) FILTER (side = 'ask'), 0) AS ar FROM z GROUP BY book),
m AS (SELECT b.book, max(abs((g.b1 - b.price) - (a.price - g.a1))) AS gap FROM z b JOIN z a ON a.book = b.book AND a.n = b.n AND a.side = 'ask' JOIN g ON g.book = b.book WHERE b.side = 'bid' GROUP BY b.book),
h AS (SELECT z.book, coalesce(sum(qty) FILTER (side = 'ask' AND price <= g.a1 + 5 * {STEP}), 0) AS door FROM z JOIN g USING (book) GROUP BY z.book)"""


@query(f"WITH {SHAPES} SELECT book, {near_sql('(bf - af) / nullif(bf + af, 0)')} AS wall_free_imbalance, {near_sql('(br - ar) / nullif(br + ar, 0)')} AS rank_imbalance, gap / {STEP} AS mismatch_steps, door AS shares_to_door FROM f LEFT JOIN m USING (book) LEFT JOIN h USING (book)")
def book_shape(spark, sf_dir):
    """Top-five imbalance without each side's largest level, rank-decayed imbalance, mismatch of the two ladders, and the ask
    quantity up to five steps above the best."""
    def free(side):
        tagged = F.transform(side, lambda x, i: F.struct(x["qty"].alias("qty"), (-i).alias("i")))
        top = F.array_max(tagged)
        return F.aggregate(F.filter(tagged, lambda x: (x["i"] != top["i"]) & (x["i"] > -5)), F.lit(0.0), lambda a, x: a + x["qty"])

    rank = lambda side: F.aggregate(F.transform(side, lambda x, i: x["qty"] / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    b1, a1 = L.best(F.col("bids"), "price"), L.best(F.col("asks"), "price")
    gaps = F.zip_with("bids", "asks", lambda b, a: F.abs((b1 - b["price"]) - (a["price"] - a1)))
    door = L.total(F.filter("asks", lambda x: x["price"] <= a1 + 5 * STEP))
    s = snapshots(spark, sf_dir)
    return s.select("book", near(L.imbalance(free("bids"), free("asks"))).alias("wall_free_imbalance"), near(L.imbalance(rank("bids"), rank("asks"))).alias("rank_imbalance"), (F.array_max(gaps) / STEP).alias("mismatch_steps"), door.alias("shares_to_door"))
