"""Queries over price limits, sessions and the whole market: limit state and streaks, auctions, context, their mechanisms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, near, near_sql
from ..operators.mechanisms import div, ramp
from ..operators.quantiles import interpolated
from ..sources.tables import BARS, TAPE, bars, table, tape
from .registry import query
from .scalar_queries import LADDER

W = "OVER (PARTITION BY symbol ORDER BY ts)"
#: Limits on a tick of a tenth, distances to them, what the session did there; the text runs on both engines.
LIMITS = {
    "upper_": "floor(price * (1 + band) * 10) / 10", "lower_": "ceil(price * (1 - band) * 10) / 10",
}
STATE = {
    "room": "(upper_ - close) / nullif(price, 0)", "floor_room": "(close - lower_) / nullif(price, 0)", "touched": "high >= upper_", "locked": "CASE WHEN close >= upper_ THEN 1 WHEN close <= lower_ THEN -1 ELSE 0 END",
    "broke": "high >= upper_ AND close < upper_", "gap": "open / nullif(price, 0) - 1", "place": "(close - low) / nullif(high - low, 0)", "open_place": "(open - low) / nullif(high - low, 0)",
}
SESSIONS = (
    f"{BARS}, p AS (SELECT *, lag(close) {W} AS price FROM bars), b AS (SELECT *, {LADDER} AS band FROM p WHERE price IS NOT NULL), l AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in LIMITS.items())} FROM b), "
    f"s AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in STATE.items())} FROM l)"
)


def sessions(spark, sf_dir):
    """Bars with the limits their previous close gives, and the session's state against them."""
    p = bars(spark, sf_dir).withColumn("price", F.lag("close").over(by_symbol())).where("price IS NOT NULL")
    b = p.withColumn("band", F.expr(LADDER))
    limited = b.selectExpr("*", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in LIMITS.items()])
    return limited.selectExpr("*", *[f"{e} AS {n}" for n, e in STATE.items()])


@query(f"WITH {SESSIONS} SELECT symbol, ts, upper_ AS upper_limit, lower_ AS lower_limit, {near_sql('room')} AS room, {near_sql(f'room - lag(room) {W}')} AS approach, touched, locked, broke FROM s")
def circuit_state(spark, sf_dir):
    """Limits, distance to the upper one and its change, and whether the session touched, closed at or fell back from it."""
    s = sessions(spark, sf_dir)
    return s.select("symbol", "ts", F.col("upper_").alias("upper_limit"), F.col("lower_").alias("lower_limit"), near("room").alias("room"), near(F.col("room") - F.lag("room").over(by_symbol())).alias("approach"), "touched", "locked", "broke")


STREAKS = f"i AS (SELECT *, sum(CASE WHEN locked = 0 OR locked <> coalesce(before, 0) THEN 1 ELSE 0 END) {W} AS island FROM (SELECT *, lag(locked) {W} AS before FROM s)), k AS (SELECT *, CASE WHEN locked = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, island ORDER BY ts) END AS streak FROM i)"


def streaks(spark, sf_dir):
    s = sessions(spark, sf_dir).withColumn("before", F.lag("locked").over(by_symbol()))
    i = s.withColumn("island", F.sum(F.when((F.col("locked") == 0) | (F.col("locked") != F.coalesce("before", F.lit(0))), 1).otherwise(0)).over(by_symbol()))
    return i.withColumn("streak", F.when(F.col("locked") == 0, 0).otherwise(F.row_number().over(Window.partitionBy("symbol", "island").orderBy("ts"))))


@query(f"WITH {SESSIONS}, {STREAKS} SELECT symbol, ts, locked, streak::BIGINT AS streak FROM k WHERE locked <> 0")
def circuit_streaks(spark, sf_dir):
    """Consecutive sessions that closed at the same limit."""
    return streaks(spark, sf_dir).where("locked <> 0").select("symbol", "ts", "locked", F.col("streak").cast("long").alias("streak"))


@query(f"WITH {SESSIONS}, h AS (SELECT symbol, year(ts)::INT AS yr, count(*) AS sessions, count(*) FILTER (touched) AS touches, count(*) FILTER (locked = 1) AS up_locks, count(*) FILTER (locked = -1) AS down_locks, max(ts) FILTER (locked <> 0) AS last_lock, max(high) AS peak FROM s GROUP BY ALL) SELECT * FROM h")
def day_history(spark, sf_dir):
    """What a symbol's earlier sessions did at the limits, by year."""
    s = sessions(spark, sf_dir)
    return s.groupBy("symbol", F.year("ts").alias("yr")).agg(
        F.count("*").alias("sessions"), F.count_if("touched").alias("touches"), F.count_if(F.col("locked") == 1).alias("up_locks"), F.count_if(F.col("locked") == -1).alias("down_locks"),
        F.max(F.when(F.col("locked") != 0, F.col("ts"))).alias("last_lock"), F.max("high").alias("peak"),
    )


@query(f"WITH {SESSIONS} SELECT symbol, ts, {near_sql('gap')} AS open_gap, {near_sql('open_place')} AS open_place, {near_sql('place')} AS close_place, {near_sql(f'lead(open) {W} / nullif(close, 0) - 1')} AS next_gap FROM s")
def auction_state(spark, sf_dir):
    """Opening gap, where open and close stand in the session's range, and the next session's gap."""
    s = sessions(spark, sf_dir)
    return s.select("symbol", "ts", near("gap").alias("open_gap"), near("open_place").alias("open_place"), near("place").alias("close_place"), near(F.try_divide(F.lead("open").over(by_symbol()), F.col("close")) - 1).alias("next_gap"))


TEN = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
SESSION_FEATURES = {
    "hits10": f"sum(CASE WHEN touched THEN 1 ELSE 0 END) {TEN}", "locks10": f"sum(CASE WHEN locked = 1 THEN 1 ELSE 0 END) {TEN}", "breaks10": f"sum(CASE WHEN broke THEN 1 ELSE 0 END) {TEN}",
    "room0": f"lag(room) {W}", "vol10": f"CAST(sum(volume) {TEN} AS DOUBLE) / count(*) {TEN}", "locked0": f"lag(locked) {W}", "gap0": f"lag(gap) {W}",
}
SESSION_MECHANISMS = {
    "circuit_regime": f"{ramp('CAST(hits10 AS DOUBLE)', 0.0, 5.0)}",
    "circuit_streak": f"{ramp('CAST(streak AS DOUBLE)', 0.0, 4.0)}",
    "circuit_prehit_pressure": f"(1 - {ramp('room', 0.0, 0.05)}) * {ramp('room0 - room', 0.0, 0.05)}",
    "circuit_lock_strength": f"CASE WHEN locked = 1 THEN 1.0 ELSE 0.0 END * {ramp('place', 0.5, 1.0)} * (1 - {ramp(div('volume', 'vol10'), 1.0, 3.0)} / 2)",
    "circuit_break_weakness": f"CASE WHEN broke THEN 1.0 ELSE 0.0 END * (1 - {ramp('place', 0.2, 0.8)})",
    "circuit_next_session": f"CASE WHEN locked0 = 1 THEN 1.0 ELSE 0.0 END * {ramp('gap', 0.0, 0.05)}",
    "auction_imbalance": f"{ramp('abs(gap)', 0.02, 0.2)} * {ramp('abs(coalesce(open_place, 0.5) - 0.5)', 0.1, 0.5)}",
    "close_session_pressure": f"{ramp('abs(coalesce(place, 0.5) - 0.5)', 0.2, 0.5)} * {ramp(div('volume', 'vol10'), 1.0, 2.0)}",
    "recovery_curve_state": f"{ramp('-gap0', 0.05, 0.5)} * {ramp('gap', 0.0, 0.5)}",
}


@query(f"WITH {SESSIONS}, {STREAKS}, f AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in SESSION_FEATURES.items())} FROM k) SELECT symbol, ts, {', '.join(f'{near_sql(e)} AS {n}' for n, e in SESSION_MECHANISMS.items())} FROM f")
def session_mechanisms(spark, sf_dir):
    """Scores of the mechanisms of limits, auctions and closes."""
    f = streaks(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in SESSION_FEATURES.items()])
    return f.select("symbol", "ts", *[near(F.expr(e)).alias(n) for n, e in SESSION_MECHANISMS.items()])


# ---- the whole market

MARKET = f"""{SESSIONS}, r AS (SELECT s.*, s_nationkey AS sector, close / nullif(price, 0) - 1 AS ret FROM s JOIN supplier ON s_suppkey = symbol),
d AS (SELECT ts, quantile_cont(ret, 0.5) AS market, count(*) AS n, sum((ret > 0)::INT) AS up, sum((abs(ret) > 0.2)::INT) AS large FROM r GROUP BY ts),
g AS (SELECT ts, sector, quantile_cont(ret, 0.5) AS sector_median, count(*) AS members, sum((locked <> 0 OR room < 0.02)::INT) AS near_limit, sum(turnover) AS turnover FROM r GROUP BY ts, sector)"""


def market(spark, sf_dir):
    """Session rows with their sector and return, the days' and the (day, sector) aggregates."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"))
    r = sessions(spark, sf_dir).join(s, "symbol").withColumn("ret", F.try_divide("close", "price") - 1)
    d = r.groupBy("ts").agg(F.percentile("ret", 0.5).alias("market"), F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.abs("ret") > 0.2).alias("large"))
    g = r.groupBy("ts", "sector").agg(F.percentile("ret", 0.5).alias("sector_median"), F.count("*").alias("members"), F.count_if((F.col("locked") != 0) | (F.col("room") < 0.02)).alias("near_limit"), F.sum("turnover").alias("turnover"))
    return r, d, g


@query(f"WITH {MARKET} SELECT symbol, ts, {near_sql('ret - market')} AS residual, {near_sql('sector_median - market')} AS sector_excess, {near_sql('up / n::DOUBLE')} AS breadth, {near_sql('large / n::DOUBLE')} AS synchrony, {near_sql('near_limit / members::DOUBLE')} AS limit_cluster FROM r JOIN d USING (ts) JOIN g USING (ts, sector)")
def cross_context(spark, sf_dir):
    """Each return against the market's and its sector's median, breadth, synchrony and the sector's share at its limits."""
    r, d, g = market(spark, sf_dir)
    x = r.join(d, "ts").join(g.drop("turnover"), ["ts", "sector"])
    return x.select("symbol", "ts", near(F.col("ret") - F.col("market")).alias("residual"), near(F.col("sector_median") - F.col("market")).alias("sector_excess"), near(F.col("up") / F.col("n")).alias("breadth"), near(F.col("large") / F.col("n")).alias("synchrony"), near(F.col("near_limit") / F.col("members")).alias("limit_cluster"))


@query(f"WITH {MARKET}, c AS (SELECT *, abs(turnover / nullif(lag(turnover) OVER (PARTITION BY sector ORDER BY ts), 0) - 1) > 1 AS changed FROM g) SELECT ts, count(*) AS sectors, {near_sql('avg(coalesce(changed, false)::INT)')} AS changed_share FROM c GROUP BY ts")
def liquidity_changes(spark, sf_dir):
    """Share of sectors whose turnover more than doubled against their session before."""
    _, _, g = market(spark, sf_dir)
    w = Window.partitionBy("sector").orderBy("ts")
    c = g.select("ts", F.coalesce(F.abs(F.try_divide("turnover", F.lag("turnover").over(w)) - 1) > 1, F.lit(False)).alias("changed"))
    return c.groupBy("ts").agg(F.count("*").alias("sectors"), near(F.avg(F.col("changed").cast("int"))).alias("changed_share"))


@query(f"""WITH {MARKET}, x AS (SELECT sector, ts, sector_median FROM g), m AS (SELECT ts, market FROM d), k AS (SELECT unnest([0, 1, 2, 3]) AS lag),
c AS (SELECT sector, lag::INT AS lag, count(*) AS n, round(corr(sector_median, market), 5) AS rho FROM x CROSS JOIN k JOIN m ON m.ts = x.ts - lag::INT GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY abs(rho) DESC, lag) AS place FROM c WHERE n >= 5 AND rho IS NOT NULL)
SELECT sector, lag AS best_lag, n, rho FROM best WHERE place = 1""")
def best_lags(spark, sf_dir):
    """The lag of 0 to 3 days at which a sector's median follows the market's most closely."""
    _, d, g = market(spark, sf_dir)
    led = d.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lag"), "ts", "market").select("lag", F.expr("date_add(ts, lag)").alias("ts"), "market")
    c = g.select("sector", "ts", "sector_median").join(led, "ts").groupBy("sector", "lag").agg(F.count("*").alias("n"), F.round(F.corr("sector_median", "market"), 5).alias("rho"))
    best = c.where("n >= 5 AND rho IS NOT NULL").groupBy("sector").agg(F.min(F.struct((-F.abs("rho")).alias("order"), "lag", "n", "rho")).alias("b"))
    return best.select("sector", F.col("b.lag").alias("best_lag"), F.col("b.n").alias("n"), F.col("b.rho").alias("rho"))


CROSS = {
    "basket_rebalance": f"{ramp('synchrony', 0.2, 0.8)} * (1 - {ramp('abs(residual)', 0.1, 0.6)})",
    "cross_lead_lag": f"{ramp('abs(before)', 0.05, 0.5)} * CASE WHEN sign(before) = sign(residual) THEN 1.0 ELSE 0.0 END",
    "metaorder_impact": f"{ramp('abs(residual)', 0.2, 1.0)} * (1 - {ramp('synchrony', 0.2, 0.8)})",
}


@query(f"WITH {MARKET}, x AS (SELECT symbol, ts, ret - market AS residual, large / n::DOUBLE AS synchrony, lag(market) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM r JOIN d USING (ts)) SELECT symbol, ts, {', '.join(f'{near_sql(e)} AS {n}' for n, e in CROSS.items())} FROM x")
def cross_mechanisms(spark, sf_dir):
    """Scores of the mechanisms that show across symbols."""
    r, d, _ = market(spark, sf_dir)
    x = r.join(d, "ts").select("symbol", "ts", (F.col("ret") - F.col("market")).alias("residual"), (F.col("large") / F.col("n")).alias("synchrony"), F.lag("market").over(by_symbol()).alias("before"))
    return x.select("symbol", "ts", *[near(F.expr(e)).alias(n) for n, e in CROSS.items()])


FAST = f"{TAPE}, x AS (SELECT symbol, event_id, CAST(floor(epoch_us(t) / 1000000) AS BIGINT) AS sec, value FROM tape), v AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY symbol ORDER BY sec, event_id)) AS moved FROM x), q AS (SELECT *, quantile_cont(moved, 0.9) OVER w AS p90, count(moved) OVER w AS n FROM v WINDOW w AS (PARTITION BY symbol ORDER BY sec RANGE BETWEEN 864000 PRECEDING AND 1 PRECEDING))"


@query(f"WITH {FAST} SELECT symbol, event_id, n, coalesce(n >= 4 AND moved >= p90, false) AS fast FROM q")
def velocity_decile(spark, sf_dir):
    """Moves at or above the ninth decile of the symbol's own moves of the ten days before."""
    w = Window.partitionBy("symbol").orderBy("sec")
    x = tape(spark, sf_dir).select("symbol", "event_id", F.unix_seconds(F.col("t").cast("timestamp")).alias("sec"), "value")
    v = x.withColumn("moved", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("symbol").orderBy("sec", "event_id"))))
    past = w.rangeBetween(-864000, -1)
    # The two moves around the percentile, as some moves are equal to it and the last digit decides.
    a = v.select("symbol", "event_id", "moved", F.sort_array(F.collect_list("moved").over(past)).alias("a")).withColumns({"n": F.size("a").cast("long"), "at": (F.size("a") - 1) * F.lit(0.9)})
    beside = a.withColumns({"lower": F.get("a", F.floor("at").cast("int")), "upper": F.get("a", F.ceil("at").cast("int")), "part": F.col("at") - F.floor("at")})
    q = beside.withColumn("p90", interpolated(F.col("lower"), F.col("upper"), F.col("part")))
    return q.select("symbol", "event_id", "n", F.coalesce((F.col("n") >= 4) & (F.col("moved") >= F.col("p90")), F.lit(False)).alias("fast"))
