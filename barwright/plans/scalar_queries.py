"""Scalar helpers, guards and rate features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, near, near_sql, pct_rank, r6
from ..operators.causal import earlier_below
from ..sources.tables import BARS, TAPE, bars, table, tape
from .registry import query

S = "PARTITION BY symbol ORDER BY ts"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {near_sql('least(greatest((l_extendedprice - 20000) / 60000, 0), 1)')} AS ramp, sign(l_discount - 0.05)::INT AS direction, {near_sql('l_tax / nullif(l_discount, 0)')} AS ratio, {near_sql('sqrt(l_quantity * l_discount)')} AS geo_mean, {near_sql('1 / (1 + exp(-(l_quantity - 25) / 10))')} AS sigmoid FROM lineitem")
def scalar_scores(spark, sf_dir):
    """Ramp, sign, safe ratio, geometric mean and logistic of line items."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", near(F.least(F.greatest((F.col("l_extendedprice") - 20000) / 60000, F.lit(0.0)), F.lit(1.0))).alias("ramp"), F.signum(d - 0.05).cast("int").alias("direction"),
        near(F.try_divide("l_tax", d)).alias("ratio"), near(F.sqrt(q * d)).alias("geo_mean"), near(1 / (1 + F.exp(-(q - 25) / 10))).alias("sigmoid"),
    )


@query("SELECT p_partkey, upper(trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', '', 'g'))) AS code, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS num FROM part")
def normalise_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.upper(F.trim(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", ""))).alias("code"), F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9]+", "-").alias("slug"), F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("double").alias("num"))


LADDER = "CAST(CASE WHEN price < 200 THEN 0.10 WHEN price < 500 THEN 0.0875 WHEN price < 1000 THEN 0.075 WHEN price < 2000 THEN 0.0625 WHEN price < 5000 THEN 0.05 ELSE 0.0375 END AS DOUBLE)"


@query(f"WITH {BARS}, p AS (SELECT symbol, ts, close, high, lag(close) OVER ({S}) AS price FROM bars), b AS (SELECT *, {LADDER} AS band FROM p WHERE price IS NOT NULL) SELECT symbol, ts, band, {near_sql('price * (1 + band)')} AS upper_limit, {near_sql('(price * (1 + band) - close) / nullif(price, 0)')} AS room, high >= price * (1 + band) AS touched FROM b")
def band_room(spark, sf_dir):
    """Price band of the previous close, the limit it gives, and the room left to it."""
    p = bars(spark, sf_dir).select("symbol", "ts", "close", "high", F.lag("close").over(by_symbol()).alias("price")).where("price IS NOT NULL")
    b = p.withColumn("band", F.expr(LADDER))
    limit = F.col("price") * (1 + F.col("band"))
    return b.select("symbol", "ts", "band", near(limit).alias("upper_limit"), near(F.try_divide(limit - F.col("close"), F.col("price"))).alias("room"), (F.col("high") >= limit).alias("touched"))


@query(f"WITH {BARS}, p AS (SELECT symbol, ts, close, lag(close) OVER ({S}) AS price FROM bars), b AS (SELECT *, {LADDER} AS band FROM p WHERE price IS NOT NULL) SELECT band, count(*) AS n, round(avg((close >= price * (1 + band))::INT), 6) AS share_at_limit, round(avg((abs(close / price - 1) <= band)::INT), 6) AS share_inside FROM b GROUP BY band")
def band_evidence(spark, sf_dir):
    p = bars(spark, sf_dir).select("symbol", "ts", "close", F.lag("close").over(by_symbol()).alias("price")).where("price IS NOT NULL").withColumn("band", F.expr(LADDER))
    share = lambda c: r6(F.avg(c.cast("int")))
    return p.groupBy("band").agg(F.count("*").alias("n"), share(F.col("close") >= F.col("price") * (1 + F.col("band"))).alias("share_at_limit"), share(F.abs(F.col("close") / F.col("price") - 1) <= F.col("band")).alias("share_inside"))


@query(f"WITH {BARS}, f AS (SELECT symbol, ts, volume, coalesce(len(list_filter([CASE WHEN volume < 5 THEN 'thin' END, CASE WHEN trades = 1 THEN 'single' END, CASE WHEN high > low * 3 THEN 'wide' END], lambda x: x IS NOT NULL)), 0) AS k, list_filter([CASE WHEN volume < 5 THEN 'thin' END, CASE WHEN trades = 1 THEN 'single' END, CASE WHEN high > low * 3 THEN 'wide' END], lambda x: x IS NOT NULL) AS r FROM bars) SELECT symbol, ts, array_to_string(r, ',') AS reasons, r[1] AS first_reason, k = 0 AS eligible FROM f")
def exclusions(spark, sf_dir):
    """All reasons a bar is excluded for, the first one, and whether it is eligible."""
    reasons = F.filter(F.array(F.when(F.col("volume") < 5, "thin"), F.when(F.col("trades") == 1, "single"), F.when(F.col("high") > F.col("low") * 3, "wide")), lambda x: x.isNotNull())
    b = bars(spark, sf_dir).select("symbol", "ts", reasons.alias("r"))
    return b.select("symbol", "ts", F.array_join("r", ",").alias("reasons"), F.get("r", F.lit(0)).alias("first_reason"), (F.size("r") == 0).alias("eligible"))


@query(f"WITH {TAPE}, x AS (SELECT symbol, event_id, epoch_us(t) / 1e6 AS sec, value FROM tape), d AS (SELECT *, sec - lag(sec) OVER w AS dt, value - lag(value) OVER w AS dv FROM x WINDOW w AS (PARTITION BY symbol ORDER BY sec, event_id)) SELECT symbol, event_id, CASE WHEN dt BETWEEN 1 AND 36000 THEN round(dv / dt, 6) END AS rate FROM d")
def gap_gated_rates(spark, sf_dir):
    """Change per second, only across gaps of one second to ten hours."""
    w = Window.partitionBy("symbol").orderBy("sec", "event_id")
    x = tape(spark, sf_dir).select("symbol", "event_id", (F.unix_micros(F.col("t").cast("timestamp")) / 1e6).alias("sec"), "value")
    dt, dv = F.col("sec") - F.lag("sec").over(w), F.col("value") - F.lag("value").over(w)
    return x.select("symbol", "event_id", F.when(dt.between(1, 36000), r6(dv / dt)).alias("rate"))


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY ts) AS p FROM bars) SELECT symbol, ts, round(p, 6) AS rank_pct, least(greatest(round_even(p * 5, 0), 0), 4)::INT AS volume_bin FROM r")
def volume_bins(spark, sf_dir):
    """Rounded fifths of the day's volume rank: bins of unequal width, as the rounding makes them."""
    p = pct_rank(F.col("volume"), Window.partitionBy("ts").orderBy("volume"), ["ts"])
    b = bars(spark, sf_dir).select("symbol", "ts", p.alias("p"))
    return b.select("symbol", "ts", r6("p").alias("rank_pct"), F.least(F.greatest(F.rint(F.col("p") * 5), F.lit(0.0)), F.lit(4.0)).cast("int").alias("volume_bin"))


@query(f"WITH {BARS}, x AS (SELECT symbol, ts, close, list(close) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM bars) SELECT symbol, ts, CASE WHEN len(past) >= 20 THEN {near_sql('len(list_filter(past, lambda y: y < close)) / len(past)::DOUBLE')} END AS own_rank FROM x")
def causal_rank(spark, sf_dir):
    """Share of a symbol's own earlier closes below the current one."""
    counts = earlier_below(bars(spark, sf_dir, together=True).select("symbol", "ts", F.unix_date("ts").alias("day"), "close"), "symbol", "day", "close")
    return counts.select("symbol", "ts", F.when(F.col("earlier") >= 20, near(F.col("below") / F.col("earlier"))).alias("own_rank"))


@query(f"WITH {BARS}, r AS (SELECT *, ln(close / nullif(lag(close) OVER ({S}), 0)) AS ret FROM bars), x AS (SELECT symbol, ts, ret, row_number() OVER ({S}) AS n FROM r WHERE ret IS NOT NULL) SELECT a.symbol, round(corr(a.ret, b.ret), 6) AS autocorrelation, count(*) AS pairs FROM x a JOIN x b ON a.symbol = b.symbol AND b.n = a.n + 1 GROUP BY a.symbol")
def autocorrelation(spark, sf_dir):
    w = by_symbol()
    r = bars(spark, sf_dir).select("symbol", "ts", F.ln(F.try_divide("close", F.lag("close").over(w))).alias("ret")).where("ret IS NOT NULL")
    p = r.withColumn("next", F.lead("ret").over(w)).where("next IS NOT NULL")
    return p.groupBy("symbol").agg(r6(F.corr("ret", "next")).alias("autocorrelation"), F.count("*").alias("pairs"))


@query(f"WITH {BARS}, t AS (SELECT ts, sum(turnover) AS total, count(*) AS n, count(*) FILTER (close > open) AS up FROM bars GROUP BY ts), m AS (SELECT *, quantile_cont(total, 0.5) OVER (ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS med, count(*) OVER (ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS k FROM t) SELECT ts, n, round(up / n::DOUBLE, 6) AS breadth, CASE WHEN k = 20 THEN round(total / nullif(med, 0), 6) END AS turnover_surprise FROM m")
def market_days(spark, sf_dir):
    """Breadth and turnover against the median of the twenty days before; one row per day enters the window."""
    t = bars(spark, sf_dir).groupBy("ts").agg(F.sum("turnover").alias("total"), F.count("*").alias("n"), F.count_if(F.col("close") > F.col("open")).alias("up"))
    w = Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(-20, -1)
    m = t.select("ts", "n", "up", "total", F.percentile("total", 0.5).over(w).alias("med"), F.count("*").over(w).alias("k"))
    return m.select("ts", "n", r6(F.col("up") / F.col("n")).alias("breadth"), F.when(F.col("k") == 20, r6(F.try_divide("total", "med"))).alias("turnover_surprise"))


@query("SELECT l_suppkey AS symbol, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, round(stddev_samp(l_extendedprice) / nullif(avg(l_extendedprice), 0), 6) AS cv, round(corr(l_extendedprice, l_quantity), 6) AS pearson, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_suppkey")
def moments(spark, sf_dir):
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(
        F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), r6(F.try_divide(F.stddev_samp(x), F.avg(x))).alias("cv"),
        r6(F.corr(x, "l_quantity")).alias("pearson"), F.round(F.regr_slope(x, F.col("l_quantity")), 4).alias("slope"),
    )
