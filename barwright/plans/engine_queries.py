"""Event-engine state as windows over snapshots and prints: order flow, cadence, impact, context, resilience, health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.windows import by_symbol, near, near_sql, r6, trailing
from ..operators.asof import asof
from ..sources.tables import BARS, BOOKS, TAPE, bars, books, table, tape
from .bars_queries import STATES, states
from .registry import query

S = "PARTITION BY symbol ORDER BY ts"
E = "PARTITION BY symbol ORDER BY sec, event_id"
SNAPS = f"""{BOOKS}, touch AS (SELECT book, max(price) FILTER (side = 'bid' AND n = 1) AS bp, coalesce(max(qty) FILTER (side = 'bid' AND n = 1), 0) AS bq, max(price) FILTER (side = 'ask' AND n = 1) AS ap, coalesce(max(qty) FILTER (side = 'ask' AND n = 1), 0) AS aq FROM ranked GROUP BY book),
snaps AS (SELECT o_custkey AS symbol, o_orderdate AS t, book, bp, bq, ap, aq FROM touch JOIN orders ON book = o_orderkey)"""
SEC = f"{TAPE}, x AS (SELECT symbol, event_id, source, CAST(floor(epoch_us(t) / 1000000) AS BIGINT) AS sec, value, k, CASE WHEN source IN ('click', 'purchase') THEN 1 ELSE -1 END AS side FROM tape)"


def snapshots(spark, sf_dir):
    """(symbol, t, book, bids, asks and the touch): a customer's orders as the snapshots of one book."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("book"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return o.join(books(spark, sf_dir), "book").select(
        "symbol", "t", "book", "bids", "asks", L.best(F.col("bids"), "price").alias("bp"), zero(L.best(F.col("bids"), "qty")).alias("bq"),
        L.best(F.col("asks"), "price").alias("ap"), zero(L.best(F.col("asks"), "qty")).alias("aq"),
    )


def seconds_tape(spark, sf_dir):
    side = F.when(F.col("source").isin("click", "purchase"), 1).otherwise(-1)
    return tape(spark, sf_dir).select("symbol", "event_id", "source", F.unix_seconds(F.col("t").cast("timestamp")).alias("sec"), "value", "k", side.alias("side"))


def prints_window():
    return Window.partitionBy("symbol").orderBy("sec", "event_id")


OFI = "CASE WHEN lag(bp) OVER w IS NULL OR lag(ap) OVER w IS NULL OR bp IS NULL OR ap IS NULL THEN NULL ELSE (CASE WHEN bp >= lag(bp) OVER w THEN bq ELSE 0 END) - (CASE WHEN bp <= lag(bp) OVER w THEN lag(bq) OVER w ELSE 0 END) - (CASE WHEN ap <= lag(ap) OVER w THEN aq ELSE 0 END) + (CASE WHEN ap >= lag(ap) OVER w THEN lag(aq) OVER w ELSE 0 END) END"


@query(f"WITH {SNAPS}, o AS (SELECT *, {OFI} AS e FROM snaps WINDOW w AS (PARTITION BY symbol ORDER BY t, book)) SELECT symbol, book, e AS ofi, sum(e) OVER (PARTITION BY symbol ORDER BY t, book ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ofi_window FROM o")
def order_flow_imbalance(spark, sf_dir):
    """Change of the touch between snapshots as order flow, and its sum over five snapshots; null without a full touch."""
    w = Window.partitionBy("symbol").orderBy("t", "book")
    p = {c: F.lag(c).over(w) for c in ("bp", "bq", "ap", "aq")}
    zero = lambda c, v: F.when(c, v).otherwise(0.0)
    e = zero(F.col("bp") >= p["bp"], F.col("bq")) - zero(F.col("bp") <= p["bp"], p["bq"]) - zero(F.col("ap") <= p["ap"], F.col("aq")) + zero(F.col("ap") >= p["ap"], p["aq"])
    full = p["bp"].isNotNull() & p["ap"].isNotNull() & F.col("bp").isNotNull() & F.col("ap").isNotNull()
    o = snapshots(spark, sf_dir).select("symbol", "t", "book", F.when(full, e).alias("ofi"))
    return o.select("symbol", "book", "ofi", F.sum("ofi").over(w.rowsBetween(-4, 0)).alias("ofi_window"))


@query(f"""WITH {SNAPS}, p AS (SELECT symbol, book, lag(book) OVER (PARTITION BY symbol ORDER BY t, book) AS prev FROM snaps), now AS (SELECT p.book, l.side, l.price, l.qty FROM p JOIN levels l ON l.book = p.book WHERE p.prev IS NOT NULL), was AS (SELECT p.book, l.side, l.price, l.qty FROM p JOIN levels l ON l.book = p.prev WHERE p.prev IS NOT NULL),
j AS (SELECT coalesce(n.book, w.book) AS book, coalesce(n.side, w.side) AS side, n.qty AS now, w.qty AS was FROM now n FULL JOIN was w ON n.book = w.book AND n.side = w.side AND n.price = w.price)
SELECT book, side, count(*) FILTER (was IS NULL) AS added, count(*) FILTER (now IS NULL) AS removed, sum(coalesce(now, 0) - coalesce(was, 0)) AS net FROM j GROUP BY ALL""")
def book_updates(spark, sf_dir):
    """Levels added and removed against the symbol's previous snapshot, per side."""
    w = Window.partitionBy("symbol").orderBy("t", "book")
    s = snapshots(spark, sf_dir).select("book", "bids", "asks", F.lag(F.struct("bids", "asks")).over(w).alias("p")).where("p IS NOT NULL")
    rows = s.select("book", F.lit("bid").alias("side"), L.difference(F.col("p.bids"), F.col("bids")).alias("d"), F.col("p.bids").alias("a"), F.col("bids").alias("b")).unionByName(
        s.select("book", F.lit("ask").alias("side"), L.difference(F.col("p.asks"), F.col("asks")).alias("d"), F.col("p.asks").alias("a"), F.col("asks").alias("b"))
    )
    of = lambda k: F.size(F.filter("d", lambda e: e["kind"] == k)).cast("long")
    return rows.where("size(a) + size(b) > 0").select("book", "side", of("ADD").alias("added"), of("REMOVE").alias("removed"), (L.total(F.col("b")) - L.total(F.col("a"))).alias("net"))


@query(f"WITH {SEC}, g AS (SELECT *, sec - lag(sec) OVER ({E}) AS gap, value - lag(value) OVER ({E}) AS dv, event_id < lag(event_id) OVER ({E}) AS back FROM x), m AS (SELECT *, quantile_cont(gap, 0.5) OVER ({E} ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS cadence, count(gap) OVER ({E} ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS n FROM g) SELECT symbol, event_id, gap, CASE WHEN n >= 5 THEN round(cadence, 6) END AS cadence, coalesce(n >= 5 AND gap > 3 * cadence, false) AS stale, coalesce(dv = 0, false) AS unchanged, coalesce(back, false) AS out_of_order FROM m")
def feed_flags(spark, sf_dir):
    """Staleness against three times the cadence of the last 64 gaps, unchanged values and order breaks."""
    w = prints_window()
    past = w.rowsBetween(-64, -1)
    g = seconds_tape(spark, sf_dir).select("symbol", "event_id", "sec", (F.col("sec") - F.lag("sec").over(w)).alias("gap"), (F.col("value") - F.lag("value").over(w)).alias("dv"), (F.col("event_id") < F.lag("event_id").over(w)).alias("back"))
    m = g.withColumn("cadence", F.percentile("gap", 0.5).over(past)).withColumn("n", F.count("gap").over(past))
    no = lambda c: F.coalesce(c, F.lit(False))
    return m.select("symbol", "event_id", "gap", F.when(F.col("n") >= 5, r6("cadence")).alias("cadence"), no((F.col("n") >= 5) & (F.col("gap") > 3 * F.col("cadence"))).alias("stale"), no(F.col("dv") == 0).alias("unchanged"), no(F.col("back")).alias("out_of_order"))


@query(f"WITH {SEC}, g AS (SELECT symbol, sec AS until, lag(sec) OVER ({E}) AS since FROM x) SELECT symbol, since, until, until - since AS silence FROM g WHERE until - since > 172800")
def gap_events(spark, sf_dir):
    """Silences of more than two days as events of their own."""
    g = seconds_tape(spark, sf_dir).select("symbol", F.col("sec").alias("until"), F.lag("sec").over(prints_window()).alias("since"))
    return g.withColumn("silence", F.col("until") - F.col("since")).where("silence > 172800").select("symbol", "since", "until", "silence")


RANGE = "PARTITION BY symbol ORDER BY sec RANGE BETWEEN {} PRECEDING AND CURRENT ROW"


@query(f"WITH {SEC} SELECT symbol, event_id, count(*) OVER d / 24.0::DOUBLE AS per_hour, sum(side * k) OVER d::BIGINT AS signed_flow, round(sum(abs(side * k)) OVER b / 10.0, 6) AS flow_baseline FROM x WINDOW d AS ({RANGE.format(86400)}), b AS ({RANGE.format(864000)})".replace("sum(side * k) OVER d::BIGINT", "CAST(sum(side * k) OVER d AS BIGINT)"))
def trade_intensity(spark, sf_dir):
    """Prints an hour and signed flow over a day, and the daily flow's ten-day baseline."""
    w = lambda n: Window.partitionBy("symbol").orderBy("sec").rangeBetween(-n, 0)
    flow = F.col("side") * F.col("k")
    return seconds_tape(spark, sf_dir).select("symbol", "event_id", (F.count("*").over(w(86400)) / 24.0).alias("per_hour"), F.sum(flow).over(w(86400)).alias("signed_flow"), r6(F.sum(F.abs(flow)).over(w(864000)) / 10.0).alias("flow_baseline"))


@query(f"WITH {SEC}, f AS (SELECT symbol, event_id, value - lag(value, 3) OVER ({E}) AS dp, sum(side * k) OVER ({E} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS flow, sum(k) OVER ({E} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS total FROM x) SELECT symbol, event_id, CASE WHEN abs(flow) >= 0.2 * total THEN {near_sql('dp / nullif(flow, 0)')} END AS impact, coalesce(abs(flow) >= 0.8 * total AND abs(dp) < 5, false) AS failed_response FROM f WHERE dp IS NOT NULL")
def price_impact(spark, sf_dir):
    """Price move per signed flow over three prints with a floor of 20 % one-sidedness; large flow without a move."""
    w = prints_window()
    last = w.rowsBetween(-2, 0)
    f = seconds_tape(spark, sf_dir).select("symbol", "event_id", (F.col("value") - F.lag("value", 3).over(w)).alias("dp"), F.sum(F.col("side") * F.col("k")).over(last).alias("flow"), F.sum("k").over(last).alias("total")).where("dp IS NOT NULL")
    return f.select("symbol", "event_id", F.when(F.abs("flow") >= 0.2 * F.col("total"), near(F.try_divide("dp", "flow"))).alias("impact"), ((F.abs("flow") >= 0.8 * F.col("total")) & (F.abs("dp") < 5)).alias("failed_response"))


@query(f"WITH {TAPE}, h AS (SELECT symbol, CAST(t AS DATE) AS day, source, max(t) AS last, count(*) AS n FROM tape GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY last DESC, source) AS k, max(last) OVER (PARTITION BY symbol, day) AS newest FROM h) SELECT symbol, day, source AS primary_source, n FROM r WHERE k = 1")
def freshest_source(spark, sf_dir):
    """Source with the latest print per symbol and day, as an aggregate of a struct."""
    h = tape(spark, sf_dir).groupBy("symbol", F.to_date("t").alias("day"), "source").agg(F.max("t").alias("last"), F.count("*").alias("n"))
    # Of equally fresh sources the first in order: the largest time, then the smallest name.
    best = h.groupBy("symbol", "day").agg(F.min(F.struct((-F.unix_micros(F.col("last").cast("timestamp"))).alias("age"), "source", "n")).alias("b"))
    return best.select("symbol", "day", F.col("b.source").alias("primary_source"), F.col("b.n").alias("n"))


RET = f"{BARS}, r AS (SELECT symbol, ts, ln(close / nullif(lag(close) OVER ({S}), 0)) AS ret FROM bars), rr AS (SELECT r.*, s_nationkey AS sector FROM r JOIN supplier ON s_suppkey = symbol WHERE ret IS NOT NULL)"


def returns(spark, sf_dir):
    r = bars(spark, sf_dir).select("symbol", "ts", F.ln(F.try_divide("close", F.lag("close").over(by_symbol()))).alias("ret")).where("ret IS NOT NULL")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"))
    return r.join(s, "symbol")


@query(f"WITH {RET}, tt AS (SELECT s_nationkey AS sector, symbol, sum(turnover) AS total FROM bars JOIN supplier ON s_suppkey = symbol GROUP BY ALL), ld AS (SELECT sector, symbol FROM tt QUALIFY row_number() OVER (PARTITION BY sector ORDER BY round(total, 2) DESC, symbol) = 1), a AS (SELECT rr.* FROM rr JOIN ld USING (sector, symbol)) SELECT a.symbol AS leader, b.symbol AS follower, d.lag::INT AS lag, count(*) AS n, round(corr(a.ret, b.ret), 6) AS rho FROM a JOIN rr b ON a.sector = b.sector JOIN (SELECT unnest([0, 1, 2]) AS lag) d ON b.ts = a.ts + d.lag::INT GROUP BY ALL HAVING count(*) >= 5")
def lead_lag(spark, sf_dir):
    """Correlation of each return with that of its sector's largest symbol 0, 1 and 2 days before.

    Only the leader of a sector meets its symbols, so the equi join on (sector, shifted day) is as large as the table.
    """
    r = returns(spark, sf_dir)
    sector = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"))
    total = bars(spark, sf_dir).groupBy("symbol").agg(F.round(F.sum("turnover"), 2).alias("total")).join(sector, "symbol")
    top = total.groupBy("sector").agg(F.min(F.struct((-F.col("total")).alias("t"), "symbol")).alias("l")).select("sector", F.col("l.symbol").alias("symbol"))
    a = r.join(top, ["sector", "symbol"]).select(F.col("symbol").alias("leader"), "sector", F.col("ret").alias("x"), "ts", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("lag")).withColumn("ts", F.date_add("ts", F.col("lag")))
    b = r.select(F.col("symbol").alias("follower"), "sector", F.col("ret").alias("y"), "ts")
    return a.join(b, ["sector", "ts"]).groupBy("leader", "follower", "lag").agg(F.count("*").alias("n"), r6(F.corr("x", "y")).alias("rho")).where("n >= 5")


@query(f"WITH {RET}, m AS (SELECT ts, sector, quantile_cont(ret, 0.5) AS med, count(*) AS n, avg((ret > 0)::INT) AS breadth FROM rr GROUP BY ALL) SELECT symbol, ts, round(ret - med, 6) AS sector_residual, n, round(breadth, 6) AS sector_breadth FROM rr JOIN m USING (ts, sector)")
def sector_context(spark, sf_dir):
    r = returns(spark, sf_dir)
    m = r.groupBy("ts", "sector").agg(F.percentile("ret", 0.5).alias("med"), F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("int")).alias("breadth"))
    return r.join(m, ["ts", "sector"]).select("symbol", "ts", r6(F.col("ret") - F.col("med")).alias("sector_residual"), "n", r6("breadth").alias("sector_breadth"))


@query(f"WITH {RET}, p AS (SELECT *, quantile_cont(abs(ret), 0.9) OVER w AS p90, count(*) OVER w AS k FROM rr WINDOW w AS ({S} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) SELECT ts, count(*) AS n, round(avg((abs(ret) >= p90)::INT), 6) AS share_expanding FROM p WHERE k >= 20 GROUP BY ts")
def synchronized_expansion(spark, sf_dir):
    """Share of symbols whose move is in the top tenth of their own past, by day."""
    w = trailing(100)
    p = returns(spark, sf_dir).select("ts", "ret", F.percentile(F.abs("ret"), 0.9).over(w).alias("p90"), F.count("*").over(w).alias("k")).where("k >= 20")
    return p.groupBy("ts").agg(F.count("*").alias("n"), r6(F.avg((F.abs("ret") >= F.col("p90")).cast("int"))).alias("share_expanding"))


@query(f"WITH {BARS}, c AS (SELECT symbol, ts, close, lag(close) OVER ({S}) AS before, list(close) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS h FROM bars) SELECT symbol, ts, CAST(list_position(list_transform(h, lambda x: x >= before * 0.95), true) AS BIGINT) AS bars_to_recover, round(list_min(h) / before - 1, 6) AS overshoot FROM c WHERE close < before * 0.7")
def resilience(spark, sf_dir):
    """After a fall of 30 % the bars until 95 % of the price before is back, within ten, and how deep it went."""
    w = by_symbol()
    c = bars(spark, sf_dir).select("symbol", "ts", "close", F.lag("close").over(w).alias("before"), F.collect_list("close").over(w.rowsBetween(1, 10)).alias("h")).where("close < before * 0.7")
    at = F.array_position(F.transform("h", lambda x: x >= F.col("before") * 0.95), F.lit(True))
    return c.select("symbol", "ts", F.when(at > 0, at).alias("bars_to_recover"), r6(F.array_min("h") / F.col("before") - 1).alias("overshoot"))


@query(f"WITH {BARS}, {STATES} SELECT symbol, ts, prev AS from_state, state AS to_state, ts - lag(ts) OVER ({S}) AS days_since FROM tr WHERE prev IS NOT NULL AND prev <> state")
def state_timeline(spark, sf_dir):
    """Transitions only, with the days since the one before."""
    t = states(bars(spark, sf_dir)).where("prev IS NOT NULL AND prev <> state")
    return t.select("symbol", "ts", F.col("prev").alias("from_state"), F.col("state").alias("to_state"), F.datediff("ts", F.lag("ts").over(by_symbol())).cast("long").alias("days_since"))


@query(f"WITH {BARS}, {STATES}, probes AS (SELECT DISTINCT symbol, CAST(date_trunc('year', ts) AS DATE) + 180 AS ts FROM bars) SELECT p.symbol, p.ts, s.state, p.ts - s.ts AS age_days FROM probes p ASOF LEFT JOIN tr s ON p.symbol = s.symbol AND p.ts >= s.ts")
def state_at(spark, sf_dir):
    """State of every symbol in the middle of each of its years."""
    s = states(bars(spark, sf_dir)).select("symbol", "ts", "state")
    probes = s.select("symbol", F.date_add(F.trunc("ts", "year"), 180).alias("ts")).distinct()
    return asof(probes, s, ["symbol"], "ts", ["state"]).select("symbol", "ts", F.col("r_state").alias("state"), F.datediff("ts", "r_ts").cast("long").alias("age_days"))


@query(f"WITH {BARS}, n AS (SELECT *, row_number() OVER ({S}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, ts, round(close, 6) AS close FROM n WHERE n <= 50 OR floor(i * 50.0 / n) <> floor((i - 1) * 50.0 / n)")
def downsample(spark, sf_dir):
    """At most fifty evenly spaced bars a symbol."""
    i, n = F.row_number().over(by_symbol()) - 1, F.count("*").over(Window.partitionBy("symbol"))
    d = bars(spark, sf_dir).select("symbol", "ts", r6("close").alias("close"), i.alias("i"), n.alias("n"))
    return d.where((F.col("n") <= 50) | (F.floor(F.col("i") * 50.0 / F.col("n")) != F.floor((F.col("i") - 1) * 50.0 / F.col("n")))).select("symbol", "ts", "close")


@query(f"WITH {SEC}, h AS (SELECT symbol, event_id, avg((source <> 'error')::INT) OVER w AS ok, count(*) OVER w AS n FROM x WINDOW w AS ({E} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, event_id, round(ok, 6) AS success, CASE WHEN n < 20 THEN 'UNKNOWN' WHEN ok >= 0.8 THEN 'HEALTHY' WHEN ok >= 0.6 THEN 'DEGRADED' ELSE 'FAILING' END AS status FROM h")
def source_health(spark, sf_dir):
    w = prints_window().rowsBetween(-19, 0)
    h = seconds_tape(spark, sf_dir).select("symbol", "event_id", F.avg((F.col("source") != "error").cast("int")).over(w).alias("ok"), F.count("*").over(w).alias("n"))
    return h.select("symbol", "event_id", r6("ok").alias("success"), F.when(F.col("n") < 20, "UNKNOWN").when(F.col("ok") >= 0.8, "HEALTHY").when(F.col("ok") >= 0.6, "DEGRADED").otherwise("FAILING").alias("status"))
