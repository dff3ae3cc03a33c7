"""Queries around as-of, nearest and interval joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, r6
from ..operators.asof import asof, nearest, seconds
from ..sources.tables import BARS, TAPE, bars, table, tape
from .registry import query

SPLIT = f"{TAPE}, a AS (SELECT symbol, t, event_id, value FROM tape WHERE source IN ('click', 'view')), b AS (SELECT symbol, t, max(value) AS value FROM tape WHERE source = 'purchase' GROUP BY ALL)"
EPOCH = "epoch_us({}) / 1e6"


def sides(spark, sf_dir):
    t = tape(spark, sf_dir)
    return t.where("source IN ('click', 'view')").select("symbol", "t", "event_id", "value"), t.where("source = 'purchase'").groupBy("symbol", "t").agg(F.max("value").alias("value"))


@query(f"WITH {SPLIT} SELECT a.event_id, b.value AS r_value, round({EPOCH.format('a.t')} - {EPOCH.format('b.t')}, 6) AS age FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.t >= b.t")
def asof_backward(spark, sf_dir):
    """Latest purchase of the same symbol at or before each click, with its age in seconds."""
    a, b = sides(spark, sf_dir)
    return asof(a, b, ["symbol"], "t", ["value"]).select("event_id", "r_value", r6(seconds(F.col("t")) - seconds(F.col("r_t"))).alias("age"))


@query(f"WITH {SPLIT} SELECT a.event_id, b.value AS r_value, round({EPOCH.format('b.t')} - {EPOCH.format('a.t')}, 6) AS wait FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.t <= b.t")
def asof_forward(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return asof(a, b, ["symbol"], "t", ["value"], "forward").select("event_id", "r_value", r6(seconds(F.col("r_t")) - seconds(F.col("t"))).alias("wait"))


@query(f"WITH {TAPE}, a AS (SELECT symbol, t, event_id FROM tape), b AS (SELECT symbol, t, max(value) AS value FROM tape GROUP BY ALL) SELECT a.event_id, b.value AS r_value FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.t > b.t")
def asof_strict_before(spark, sf_dir):
    """Previous event of the symbol, the row's own instant excluded."""
    t = tape(spark, sf_dir)
    own = t.groupBy("symbol", "t").agg(F.max("value").alias("value"))
    return asof(t.select("symbol", "t", "event_id"), own, ["symbol"], "t", ["value"], strict=True).select("event_id", "r_value")


@query(f"WITH {TAPE}, h AS (SELECT date_trunc('hour', t) AS t, count(*) AS n, round(sum(value), 4) AS total FROM tape GROUP BY ALL), a AS (SELECT event_id, t FROM tape WHERE source = 'signup') SELECT a.event_id, h.n AS r_n, h.total AS r_total FROM a ASOF LEFT JOIN h ON a.t >= h.t + INTERVAL 1 HOUR")
def market_asof(spark, sf_dir):
    """Last complete hour of the whole market for each signup: no key, so days make the partitions.

    The hourly table ends a day's partition with the day before's last row, so that no window spans all rows.
    """
    t = tape(spark, sf_dir)
    h = t.groupBy(F.date_trunc("hour", "t").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    h = h.select((F.col("hour") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("t"), "n", "total")
    a = t.where("source = 'signup'").select("event_id", "t")
    last = h.groupBy(F.to_date("t").alias("day")).agg(F.max_by(F.struct("n", "total", "t"), "t").alias("l"))
    days = a.select(F.to_date("t").alias("day")).distinct().unionByName(last.select("day")).distinct()
    carried = days.join(last, "day", "left").withColumn("c", F.last("l", True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))  # one row a day
    start = carried.where("c IS NOT NULL").select("day", F.col("day").cast("timestamp_ntz").alias("t"), F.col("c.n").alias("n"), F.col("c.total").alias("total"))
    known = h.withColumn("day", F.to_date("t"))
    right = start.join(known.select("day", "t"), ["day", "t"], "left_anti").unionByName(known.select("day", "t", "n", "total"))
    return asof(a.withColumn("day", F.to_date("t")), right, ["day"], "t", ["n", "total"]).select("event_id", "r_n", "r_total")


@query(f"WITH {SPLIT} SELECT a.event_id, CASE WHEN b.t IS NULL THEN 'NOT_YET_OBSERVED' WHEN {EPOCH.format('a.t')} - {EPOCH.format('b.t')} <= 86400 THEN 'OBSERVED' ELSE 'STALE' END AS status FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.t >= b.t")
def asof_status(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    j = asof(a, b, ["symbol"], "t", ["value"])
    age = seconds(F.col("t")) - seconds(F.col("r_t"))
    return j.select("event_id", F.when(F.col("r_t").isNull(), "NOT_YET_OBSERVED").when(age <= 86400, "OBSERVED").otherwise("STALE").alias("status"))


@query(f"""WITH {SPLIT}, x AS (SELECT a.event_id, {EPOCH.format('b.t')} - {EPOCH.format('a.t')} AS dt, b.value FROM a JOIN b ON a.symbol = b.symbol AND abs({EPOCH.format('b.t')} - {EPOCH.format('a.t')}) <= 21600),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(dt), dt) AS k FROM x) SELECT a.event_id, n.value AS r_value, round(n.dt, 6) AS dt FROM a LEFT JOIN n ON a.event_id = n.event_id AND n.k = 1""")
def nearest_within(spark, sf_dir):
    """Nearest purchase within six hours on either side."""
    a, b = sides(spark, sf_dir)
    return nearest(a, b, ["symbol"], "t", ["value"], 21600).select("event_id", "r_value", r6("dt").alias("dt"))


@query(f"""WITH {SPLIT}, x AS (SELECT b.symbol, b.t, a.event_id FROM b JOIN a ON a.symbol = b.symbol AND abs({EPOCH.format('b.t')} - {EPOCH.format('a.t')}) <= 21600) SELECT symbol, t, value FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = b.symbol AND x.t = b.t)""")
def orphans(spark, sf_dir):
    """Purchases no click is near: frames of their own in the fusion."""
    a, b = sides(spark, sf_dir)
    near = nearest(b, a.groupBy("symbol", "t").agg(F.min("event_id").alias("event_id")), ["symbol"], "t", ["event_id"], 21600)
    return near.where("r_event_id IS NULL").select("symbol", "t", "value")


@query(f"""WITH {SPLIT}, f AS (SELECT *, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS prev FROM b)
SELECT f.symbol, f.t, count(a.event_id) AS prints, round(coalesce(sum(a.value), 0), 6) AS flow FROM f LEFT JOIN a ON a.symbol = f.symbol AND a.t <= f.t AND (f.prev IS NULL OR a.t > f.prev) GROUP BY ALL""")
def interval_tape_join(spark, sf_dir):
    """Clicks between the previous purchase and each purchase: every print goes forward to its frame, then one aggregate."""
    a, b = sides(spark, sf_dir)
    to = asof(a, b, ["symbol"], "t", ["value"], "forward").where("r_t IS NOT NULL")
    sums = to.groupBy("symbol", F.col("r_t").alias("t")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    j = b.join(sums, ["symbol", "t"], "left")
    return j.select("symbol", "t", F.coalesce("n", F.lit(0)).alias("prints"), r6(F.coalesce("s", F.lit(0.0))).alias("flow"))


@query(f"""WITH {TAPE}, u AS (SELECT symbol, t, max(value) AS value FROM tape GROUP BY ALL), p AS (SELECT *, t + INTERVAL 12 HOUR AS at FROM u)
SELECT p.symbol, p.t, round(CASE WHEN q.t > p.t THEN q.value - p.value END, 6) AS change_12h FROM p ASOF LEFT JOIN u q ON p.symbol = q.symbol AND p.at >= q.t""")
def outcome_at_horizon(spark, sf_dir):
    """Change to the last value at or before twelve hours later, null if that is the row itself."""
    u = tape(spark, sf_dir).groupBy("symbol", "t").agg(F.max("value").alias("value"))
    p = u.select("symbol", (F.col("t") + F.expr("INTERVAL 12 HOURS")).alias("t"), F.col("t").alias("t0"), F.col("value").alias("v0"))
    j = asof(p, u, ["symbol"], "t", ["value"])
    return j.select("symbol", F.col("t0").alias("t"), r6(F.when(F.col("r_t") > F.col("t0"), F.col("r_value") - F.col("v0"))).alias("change_12h"))


@query(f"""WITH {TAPE}, u AS (SELECT symbol, t, max(value) AS value FROM tape GROUP BY ALL), p AS (SELECT *, t + INTERVAL 6 HOUR AS at FROM u)
SELECT p.symbol, p.t, round(q.value - p.value, 6) AS label, round({EPOCH.format('q.t')} - {EPOCH.format('p.t')}, 6) AS dt FROM p ASOF JOIN u q ON p.symbol = q.symbol AND p.at <= q.t WHERE {EPOCH.format('q.t')} - {EPOCH.format('p.t')} <= 43200""")
def forward_label(spark, sf_dir):
    """First row at or after the horizon, valid up to twice the horizon."""
    u = tape(spark, sf_dir).groupBy("symbol", "t").agg(F.max("value").alias("value"))
    p = u.select("symbol", (F.col("t") + F.expr("INTERVAL 6 HOURS")).alias("t"), F.col("t").alias("t0"), F.col("value").alias("v0"))
    j = asof(p, u, ["symbol"], "t", ["value"], "forward").withColumn("dt", seconds(F.col("r_t")) - seconds(F.col("t0")))
    return j.where("dt <= 43200").select("symbol", F.col("t0").alias("t"), r6(F.col("r_value") - F.col("v0")).alias("label"), r6("dt").alias("dt"))


@query("SELECT s_suppkey AS symbol, n_name AS sector, r_name AS exchange FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def sector_map(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("sector"), F.col("r_name").alias("exchange"))


@query(f"""WITH {BARS}, l AS (SELECT symbol, arg_max(close, ts) AS close, arg_max(open, ts) AS open, arg_max(turnover, ts) AS turnover FROM bars GROUP BY symbol)
SELECT n_name AS sector, count(*) AS symbols, count(l.symbol) AS priced, round(sum(turnover), 4) AS turnover, count(*) FILTER (close > open) AS up, count(*) FILTER (close < open) AS down, round(avg(close / nullif(open, 0) - 1), 6) AS mean_change
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN l ON l.symbol = s_suppkey GROUP BY n_name""")
def sector_summary(spark, sf_dir):
    """Latest bars by sector: sums, breadth and mean change; symbols without bars are counted."""
    last = bars(spark, sf_dir).groupBy("symbol").agg(F.max_by(F.struct("close", "open", "turnover"), "ts").alias("l")).select("symbol", "l.*")
    s = sector_map(spark, sf_dir).join(last, "symbol", "left")
    return s.groupBy("sector").agg(
        F.count("*").alias("symbols"), F.count("close").alias("priced"), F.round(F.sum("turnover"), 4).alias("turnover"), F.count_if(F.col("close") > F.col("open")).alias("up"),
        F.count_if(F.col("close") < F.col("open")).alias("down"), r6(F.avg(F.try_divide("close", "open") - 1)).alias("mean_change"),
    )


@query("""WITH u AS (SELECT l_suppkey AS symbol, 'line' AS s FROM lineitem UNION SELECT s_suppkey, 'supplier' FROM supplier UNION SELECT user_id, 'event' FROM events)
SELECT symbol, bool_or(s = 'line') AS in_lines, bool_or(s = 'supplier') AS in_suppliers, bool_or(s = 'event') AS in_events FROM u GROUP BY symbol""")
def universe(spark, sf_dir):
    """Full outer union of three surfaces with membership flags, as one aggregate."""
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("symbol"), F.lit(s).alias("s")).distinct() for t, c, s in (("lineitem", "l_suppkey", "line"), ("supplier", "s_suppkey", "supplier"), ("events", "user_id", "event"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("symbol").agg(*[F.bool_or(F.col("s") == s).alias(n) for s, n in (("line", "in_lines"), ("supplier", "in_suppliers"), ("event", "in_events"))])


@query("""WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, 'ship_only' AS side FROM (SELECT d FROM a EXCEPT SELECT d FROM b) UNION ALL SELECT d, 'order_only' FROM (SELECT d FROM b EXCEPT SELECT d FROM a)""")
def calendar_differences(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    b = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return a.join(b, "d", "left_anti").withColumn("side", F.lit("ship_only")).unionByName(b.join(a, "d", "left_anti").withColumn("side", F.lit("order_only")))


PIT = f"""{BARS}, x AS (SELECT symbol, ts, ln(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS v FROM bars), r AS (SELECT * FROM x WHERE v IS NOT NULL),
i AS (SELECT DISTINCT ts FROM r), e AS (SELECT DISTINCT symbol FROM r), g AS (SELECT e.symbol, i.ts, r.v, r.ts AS own FROM e CROSS JOIN i LEFT JOIN r ON r.symbol = e.symbol AND r.ts = i.ts),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS lv, last_value(own IGNORE NULLS) OVER w AS lt FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
fresh AS (SELECT * FROM f WHERE lv IS NOT NULL AND ts - lt <= 10)"""


@query(f"""WITH {PIT}, s AS (SELECT ts, count(*) AS n, sum(lv) AS total FROM fresh GROUP BY ts) SELECT f.symbol, f.ts, n - 1 AS others, round((total - f.v) / nullif(n - 1, 0), 6) AS loo_mean FROM fresh f JOIN s USING (ts) WHERE f.v IS NOT NULL""")
def pit_cross_section(spark, sf_dir):
    """Each return against the latest return of every other symbol at that instant, stale ones up to ten days included.

    An entity's value stands from its day until its next one, ten days at most, so it is turned into the instants it
    stands at; per instant one partial aggregate, and the row itself is taken out of the sum.
    """
    r = bars(spark, sf_dir).select("symbol", "ts", F.ln(F.try_divide("close", F.lag("close").over(by_symbol()))).alias("v")).where("v IS NOT NULL")
    until = F.least(F.date_add("ts", 10), F.coalesce(F.date_sub(F.lead("ts").over(by_symbol()), 1), F.lit("9999-01-01").cast("date")))
    stands = r.withColumn("until", until).withColumn("at", F.explode(F.sequence("ts", "until")))
    sums = stands.join(r.select(F.col("ts").alias("at")).distinct(), "at", "left_semi").groupBy("at").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    j = r.join(sums, F.col("ts") == F.col("at"))
    return j.select("symbol", "ts", (F.col("n") - 1).alias("others"), r6(F.try_divide(F.col("total") - F.col("v"), F.col("n") - 1)).alias("loo_mean"))
