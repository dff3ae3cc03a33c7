"""Queries over daily bars: loading, audit, features, labels, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, guarded, near, near_sql, pct_rank, r6, robust_z, run_length, trailing
from ..operators.quantiles import summed_up
from ..operators.shared import stored
from ..sources.tables import BARS, bars, table
from .registry import query

S = "PARTITION BY symbol ORDER BY ts"


@query(f"WITH {BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, turnover, trades FROM bars")
def load_bars(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "ts", *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume", "turnover", "trades")


@query("SELECT p_partkey, p_type, p_name, NOT regexp_matches(upper(p_type || ' ' || p_name), 'PROMO|BOLT|ECONOMY') AS is_equity FROM part")
def looks_equity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_type", "p_name", (~F.upper(F.concat_ws(" ", "p_type", "p_name")).rlike("PROMO|BOLT|ECONOMY")).alias("is_equity"))


@query(f"WITH {BARS}, r AS (SELECT date_trunc('month', min(ts)) AS a, max(ts) AS b FROM bars) SELECT CAST(m AS DATE) AS month_start, CAST(last_day(m) AS DATE) AS month_end FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM r)")
def month_windows(spark, sf_dir):
    """Calendar months from the first to the last bar."""
    r = bars(spark, sf_dir).agg(F.trunc(F.min("ts"), "month").alias("a"), F.max("ts").alias("b"))
    m = r.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month_start"))
    return m.select("month_start", F.last_day("month_start").alias("month_end"))


@query(f"""WITH {BARS}, n AS (SELECT symbol, ts, close, CASE WHEN trades > 1 THEN close ELSE close * 1.001 END AS other FROM bars WHERE volume > 10)
SELECT count(*) AS n_overlap, round(100.0 * avg(CASE WHEN abs(close - other) <= 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS match_pct, round(max(abs(close - other)), 6) AS max_abs_diff FROM n""")
def verify_overlap(spark, sf_dir):
    """Agreement of two sources on the keys they share: per field share of equal values and largest difference."""
    a = bars(spark, sf_dir)
    b = a.where("volume > 10").select("symbol", "ts", F.when(F.col("trades") > 1, F.col("close")).otherwise(F.col("close") * 1.001).alias("other"))
    both = a.join(b, ["symbol", "ts"])
    gap = F.abs(F.col("close") - F.col("other"))
    return both.agg(F.count("*").alias("n_overlap"), r6(100 * F.avg((gap <= 1e-9).cast("double"))).alias("match_pct"), r6(F.max(gap)).alias("max_abs_diff"))


@query(f"WITH {BARS} SELECT symbol, ts, round(close, 6) AS close, CASE WHEN ts <= DATE '2000-01-01' THEN 'base' ELSE 'extension' END AS source FROM bars")
def source_preference_append(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", r6("close").alias("close"))
    base, more = b.where("ts <= DATE'2000-01-01'"), b.where("ts > DATE'2000-01-01'")
    return base.withColumn("source", F.lit("base")).unionByName(more.withColumn("source", F.lit("extension")), allowMissingColumns=True)


def panel() -> F.Column:
    return F.when(F.col("ts") < "1998-01-01", "PRIMARY").when(F.col("ts") >= "1998-02-01", "POSTBREAK")


PANEL = "CASE WHEN ts < DATE '1998-01-01' THEN 'PRIMARY' WHEN ts >= DATE '1998-02-01' THEN 'POSTBREAK' END"


@query(f"""WITH {BARS}, b AS (SELECT *, {PANEL} AS panel FROM bars), d AS (SELECT panel, ts, count(DISTINCT symbol) AS n FROM b WHERE panel IS NOT NULL GROUP BY ALL)
SELECT panel, count(*) AS n_rows, count(DISTINCT symbol) AS symbols, min(ts) AS first_day, max(ts) AS last_day, (SELECT round(quantile_cont(n, 0.5), 6) FROM d WHERE d.panel = b.panel) AS median_symbols_per_day
FROM b WHERE panel IS NOT NULL GROUP BY panel""")
def panel_summary(spark, sf_dir):
    """Rows, symbols, range and median breadth of each panel; dates in the break belong to none."""
    b = bars(spark, sf_dir).withColumn("panel", panel()).where("panel IS NOT NULL")
    daily = b.groupBy("panel", "ts").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("s"))
    wide = daily.groupBy("panel").agg(F.sum("n").alias("n_rows"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"), r6(F.percentile("s", 0.5)).alias("median_symbols_per_day"))
    return wide.join(b.groupBy("panel").agg(F.countDistinct("symbol").alias("symbols")), "panel")


AUDIT = f"""audit AS (
  SELECT *, high < low OR open > high OR open < low AS f_ohlc, volume <= 2 AS f_thin, high = low AND open = close AS f_locked,
    ts - lag(ts) OVER ({S}) > 10 AS f_gap, close = lag(close) OVER ({S}) AS f_stale, abs(open / nullif(lag(close) OVER ({S}), 0) - 1) > 0.5 AS f_jump
  FROM bars)"""


def audited(spark, sf_dir) -> DataFrame:
    b, w = bars(spark, sf_dir), by_symbol()
    prev = F.lag("close").over(w)
    return b.select(
        "*", ((F.col("high") < F.col("low")) | (F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))).alias("f_ohlc"), (F.col("volume") <= 2).alias("f_thin"),
        ((F.col("high") == F.col("low")) & (F.col("open") == F.col("close"))).alias("f_locked"), (F.datediff("ts", F.lag("ts").over(w)) > 10).alias("f_gap"),
        (F.col("close") == prev).alias("f_stale"), (F.abs(F.try_divide("open", prev) - 1) > 0.5).alias("f_jump"),
    )


FLAGS = ["f_ohlc", "f_thin", "f_locked", "f_gap", "f_stale", "f_jump"]


@query(f"WITH {BARS}, {AUDIT} SELECT symbol, ts, " + ", ".join(f"coalesce({f}, false) AS {f}" for f in FLAGS) + " FROM audit")
def qa_audit(spark, sf_dir):
    """Non-repairing audit flags per bar."""
    return audited(spark, sf_dir).select("symbol", "ts", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])


@query(f"WITH {BARS}, {AUDIT}, long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS reason, symbol FROM audit WHERE {f}" for f in FLAGS) + ") SELECT reason, count(*) AS n, count(DISTINCT symbol) AS symbols FROM long GROUP BY reason")
def qa_exclusions(spark, sf_dir):
    """Each reason's count; a bar with several reasons counts for each."""
    reasons = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAGS]), lambda x: x.isNotNull())
    return audited(spark, sf_dir).select("symbol", F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))


@query(f"WITH {BARS}, a AS (SELECT year(ts)::INT AS y, symbol, volume, trades, high, low FROM bars) SELECT symbol, y AS year, count(*) AS bars, count(*) FILTER (trades = 1) AS single_trade, count(*) FILTER (high = low) AS one_price, sum(volume) AS volume, round(avg(trades), 6) AS mean_trades FROM a GROUP BY ALL")
def qa_symbol_year(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("year", F.year("ts"))
    return b.groupBy("symbol", "year").agg(F.count("*").alias("bars"), F.count_if(F.col("trades") == 1).alias("single_trade"), F.count_if(F.col("high") == F.col("low")).alias("one_price"), F.sum("volume").alias("volume"), r6(F.avg("trades")).alias("mean_trades"))


UP = f"up AS (SELECT *, coalesce(close > lag(close) OVER ({S}), false) AS b FROM bars), isl AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER ({S} ROWS UNBOUNDED PRECEDING) AS i FROM up)"


@query(f"WITH {BARS}, {UP} SELECT symbol, ts, sum(b::INT) OVER (PARTITION BY symbol, i ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS up_run, sum(b::INT) OVER (PARTITION BY symbol, i)::BIGINT AS whole_run FROM isl")
def run_lengths(spark, sf_dir):
    """Rising closes in a row up to the bar, and the length of the whole run the bar is in (which looks ahead)."""
    b = bars(spark, sf_dir)
    b = b.withColumn("up", F.coalesce(F.col("close") > F.lag("close").over(by_symbol()), F.lit(False)))
    b = b.withColumn("island", F.sum((~F.col("up")).cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    b = run_length(F.col("up"), "up_run", b)
    return b.select("symbol", "ts", "up_run", F.sum(F.col("up").cast("int")).over(Window.partitionBy("symbol", "island")).alias("whole_run"))


VZ = f"""x AS (SELECT *, ln(1 + greatest(volume, 0)) AS lv FROM bars),
m AS (SELECT *, count(lv) OVER w AS n, quantile_cont(lv, 0.5) OVER w AS med, mad(lv) OVER w AS dev FROM x WINDOW w AS ({S} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
z AS (SELECT symbol, ts, CASE WHEN n >= 15 THEN (lv - med) / nullif(greatest(1.4826 * dev, 0.05 * abs(med)), 0) END AS rel_volume_z FROM m)"""


@query(f"""WITH {BARS}, {VZ} SELECT symbol, ts, round(rel_volume_z, 6) AS rel_volume_z,
CASE WHEN zr IS NOT NULL THEN round((rank() OVER (PARTITION BY ts ORDER BY zr NULLS LAST) + (count(zr) OVER (PARTITION BY ts, zr) - 1) / 2.0) / count(zr) OVER (PARTITION BY ts), 6) END AS xs_rank
FROM (SELECT *, round(rel_volume_z, 9) AS zr FROM z)""")
def volume_surprise_rank(spark, sf_dir):
    """How unusual each bar's volume is against its symbol's own past, and its rank across the market that day."""
    x = bars(spark, sf_dir).withColumn("lv", F.log1p(F.greatest("volume", F.lit(0.0))))
    z = x.select("symbol", "ts", robust_z(F.col("lv"), 60).alias("z")).withColumn("zr", F.round("z", 9))
    rank = pct_rank(F.col("zr"), Window.partitionBy("ts").orderBy(F.col("zr").asc_nulls_last()), ["ts"])
    return z.select("symbol", "ts", r6("z").alias("rel_volume_z"), r6(rank).alias("xs_rank"))


FEATURES = f"""r AS (SELECT *, ln(close / nullif(lag(close) OVER ({S}), 0)) AS ret, ln(high / nullif(low, 0)) AS rng FROM bars),
f AS (SELECT *, row_number() OVER ({S}) AS rn, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS sd, avg(ret) OVER w AS mu, avg(rng) OVER w AS mr, CAST(sum(CAST(volume AS BIGINT)) OVER w AS DOUBLE) AS sv, CAST(sum(CAST(volume AS BIGINT) * CAST(volume AS BIGINT)) OVER w AS DOUBLE) AS sv2,
   avg(abs(ret) / nullif(turnover, 0)) OVER w AS illiq, avg((ret > 0)::INT) OVER w AS up FROM r WINDOW w AS ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


def symbol_features(b: DataFrame) -> DataFrame:
    """Trailing features of 20 bars, null until the symbol has 10 observations in them and 30 bars before."""
    w = trailing(20)
    r = b.withColumn("ret", F.try_divide("close", F.lag("close").over(by_symbol()))).withColumn("ret", F.ln("ret")).withColumn("rng", F.ln(F.try_divide("high", "low")))
    old, whole = F.row_number().over(by_symbol()) > 30, F.col("volume").cast("long")  # volumes are whole numbers: exact sums in any order
    g = lambda v: F.when(old, guarded(v, F.col("ret"), w, 10))
    return r.select(
        "*", g(F.stddev_samp("ret").over(w)).alias("volatility"), g(F.avg("ret").over(w)).alias("momentum"), g(F.avg("rng").over(w)).alias("mean_range"),
        g(F.try_divide(F.sum(whole * whole).over(w).cast("double"), F.sum(whole).over(w).cast("double") * F.sum(whole).over(w).cast("double"))).alias("volume_hhi"),
        g(F.avg(F.try_divide(F.abs("ret"), F.col("turnover"))).over(w)).alias("illiquidity"), g(F.avg((F.col("ret") > 0).cast("int")).over(w)).alias("up_share"),
    )


OK = f"CASE WHEN rn > 30 AND n >= 10 THEN {near_sql('{}')} END"


@query(f"WITH {BARS}, {FEATURES} SELECT symbol, ts, {near_sql('ret')} AS ret, {OK.format('sd')} AS volatility, {OK.format('mu')} AS momentum, {OK.format('mr')} AS mean_range, {OK.format('sv2 / nullif(sv * sv, 0)')} AS volume_hhi, {OK.format('illiq * 1e6')} AS illiquidity, {OK.format('up')} AS up_share FROM f")
def trailing_features(spark, sf_dir):
    f = symbol_features(bars(spark, sf_dir)).withColumn("illiquidity", F.col("illiquidity") * 1e6)
    return f.select("symbol", "ts", *[near(c).alias(c) for c in ("ret", "volatility", "momentum", "mean_range", "volume_hhi", "illiquidity", "up_share")])


@query(f"WITH {BARS}, r AS (SELECT symbol, ts, ln(close / nullif(lag(close) OVER ({S}), 0)) AS ret FROM bars), m AS (SELECT ts, quantile_cont(ret, 0.5) AS med, avg((ret > 0)::INT) AS breadth, count(ret) AS n FROM r GROUP BY ts) SELECT symbol, ts, round(ret - med, 6) AS xs_excess, round(med, 6) AS market_ret, round(breadth, 6) AS breadth, n FROM r JOIN m USING (ts) WHERE ret IS NOT NULL")
def cross_section(spark, sf_dir):
    """Deviation from the day's median return, and the day's breadth."""
    r = bars(spark, sf_dir).select("symbol", "ts", F.ln(F.try_divide("close", F.lag("close").over(by_symbol()))).alias("ret"))
    m = r.groupBy("ts").agg(F.percentile("ret", 0.5).alias("med"), F.avg((F.col("ret") > 0).cast("int")).alias("breadth"), F.count("ret").alias("n"))
    return r.where("ret IS NOT NULL").join(m, "ts").select("symbol", "ts", r6(F.col("ret") - F.col("med")).alias("xs_excess"), r6("med").alias("market_ret"), r6("breadth").alias("breadth"), "n")


@query(f"WITH {BARS}, {FEATURES}, long AS (SELECT 'volatility' AS feature, CASE WHEN rn > 30 AND n >= 10 THEN sd END AS v FROM f UNION ALL SELECT 'momentum', CASE WHEN rn > 30 AND n >= 10 THEN mu END FROM f UNION ALL SELECT 'mean_range', CASE WHEN rn > 30 AND n >= 10 THEN mr END FROM f) SELECT feature, round(count(v) / count(*)::DOUBLE, 6) AS coverage, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.99), 6) AS p99 FROM long GROUP BY feature")
def feature_profile(spark, sf_dir):
    """Coverage, moments and tails of each feature, over the long form."""
    names = ["volatility", "momentum", "mean_range"]
    sums = r6(F.count("v") / F.count("*")).alias("coverage"), r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd")
    with stored(symbol_features(bars(spark, sf_dir)).select(*names)) as f:
        g = summed_up(f.unpivot([], names, "feature", "v"), ["feature"], "v", {"p01": 0.01, "p99": 0.99}, *sums)
    return g.select("feature", "coverage", "mean", "sd", r6("p01").alias("p01"), r6("p99").alias("p99"))


@query(f"""WITH {BARS}, f AS (SELECT *, lead(close, 5) OVER ({S}) AS c5, max(high) OVER w AS mx, min(low) OVER w AS mn, count(*) OVER w AS n FROM bars WINDOW w AS ({S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT symbol, ts, round(ln(c5 / nullif(close, 0)), 6) AS fwd_ret_5, CASE WHEN n = 5 THEN round(mx / nullif(close, 0) - 1, 6) END AS fwd_mfe_5, CASE WHEN n = 5 THEN round(mn / nullif(close, 0) - 1, 6) END AS fwd_mae_5, CASE WHEN n = 5 THEN mx >= close * 1.1 END AS fwd_move_5 FROM f""")
def forward_labels(spark, sf_dir):
    """Forward return, best and worst excursion over five bars; null where fewer follow."""
    w = by_symbol().rowsBetween(1, 5)
    full = lambda x: F.when(F.count("*").over(w) == 5, x)
    return bars(spark, sf_dir).select(
        "symbol", "ts", r6(F.ln(F.try_divide(F.lead("close", 5).over(by_symbol()), F.col("close")))).alias("fwd_ret_5"),
        full(r6(F.try_divide(F.max("high").over(w), F.col("close")) - 1)).alias("fwd_mfe_5"), full(r6(F.try_divide(F.min("low").over(w), F.col("close")) - 1)).alias("fwd_mae_5"),
        full(F.max("high").over(w) >= F.col("close") * 1.1).alias("fwd_move_5"),
    )


@query(f"""WITH {BARS}, d AS (SELECT DISTINCT ts FROM bars), s AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol),
g AS (SELECT s.symbol, d.ts FROM s JOIN d ON d.ts BETWEEN s.a AND s.b), x AS (SELECT g.symbol, g.ts, b.close, b.open FROM g LEFT JOIN bars b USING (symbol, ts)),
o AS (SELECT *, lead(open, 1) OVER ({S}) AS entry, lead(close, 3) OVER ({S}) AS exit FROM x)
SELECT symbol, ts, entry IS NOT NULL AS tradeable, round(exit / nullif(entry, 0) - 1, 6) AS ret_next_open_3 FROM o WHERE close IS NOT NULL""")
def calendar_outcomes(spark, sf_dir):
    """Outcomes on the market's calendar: entry at the next market day's open, exit on the third, null where none traded.

    Each symbol's range is densified by the market's days it spans, not by its own bars.
    """
    b = bars(spark, sf_dir)
    # A symbol and a market day meet by month, which a symbol's span lists.
    days = b.select("ts").distinct().withColumn("month", F.trunc("ts", "month"))
    spans = b.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    months = spans.withColumn("month", F.explode(F.expr("sequence(trunc(a, 'month'), trunc(b, 'month'), INTERVAL 1 MONTH)")))
    grid = months.join(days, "month").where("ts BETWEEN a AND b").select("symbol", "ts")
    x = grid.join(b.select("symbol", "ts", "open", "close"), ["symbol", "ts"], "left")
    o = x.select("symbol", "ts", "close", F.lead("open", 1).over(by_symbol()).alias("entry"), F.lead("close", 3).over(by_symbol()).alias("exit"))
    return o.where("close IS NOT NULL").select("symbol", "ts", F.col("entry").isNotNull().alias("tradeable"), r6(F.try_divide("exit", "entry") - 1).alias("ret_next_open_3"))


@query(f"""WITH {BARS}, w AS (SELECT symbol, ts, list(high) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS h, close FROM bars)
SELECT symbol, ts, CAST(list_position(list_transform(h, lambda x: x >= close * 1.25), true) AS BIGINT) AS days_to_hit, coalesce(len(h), 0)::BIGINT AS measurable FROM w""")
def first_hit(spark, sf_dir):
    """Bars until the high first reaches 1.25 times the close, within ten; null if it never does."""
    ahead = F.collect_list("high").over(by_symbol().rowsBetween(1, 10))
    b = bars(spark, sf_dir).select("symbol", "ts", "close", ahead.alias("h"))
    at = F.array_position(F.transform("h", lambda x: x >= F.col("close") * 1.25), F.lit(True))
    return b.select("symbol", "ts", F.when(at > 0, at).alias("days_to_hit"), F.size("h").cast("long").alias("measurable"))


STATES = f"""v AS (SELECT symbol, ts, list(trades * volume) OVER ({S} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS past, trades * volume AS x FROM bars),
p AS (SELECT *, CASE WHEN len(past) >= 30 THEN len(list_filter(past, lambda y: y < x)) / len(past)::DOUBLE END AS pct FROM v),
st AS (SELECT *, CASE WHEN pct IS NULL THEN 'UNKNOWN' WHEN pct >= 0.95 THEN 'EXTREME' WHEN pct >= 0.8 THEN 'ELEVATED' WHEN pct >= 0.2 THEN 'NORMAL' ELSE 'QUIET' END AS state FROM p),
tr AS (SELECT *, lag(state) OVER ({S}) AS prev, lag(state, 2) OVER ({S}) AS prev2 FROM st)"""


def states(b: DataFrame) -> DataFrame:
    """Activity percentile in the symbol's own past (100 bars, 30 at least), its state, and the states before."""
    x = (F.col("trades") * F.col("volume")).alias("x")
    v = b.select("symbol", "ts", "close", x, F.collect_list(F.col("trades") * F.col("volume")).over(trailing(100)).alias("past"))
    pct = F.when(F.size("past") >= 30, F.size(F.filter("past", lambda y: y < F.col("x"))) / F.size("past"))
    s = v.withColumn("pct", pct).withColumn(
        "state", F.when(F.col("pct").isNull(), "UNKNOWN").when(F.col("pct") >= 0.95, "EXTREME").when(F.col("pct") >= 0.8, "ELEVATED").when(F.col("pct") >= 0.2, "NORMAL").otherwise("QUIET")
    )
    return s.withColumn("prev", F.lag("state").over(by_symbol())).withColumn("prev2", F.lag("state", 2).over(by_symbol()))


@query(f"WITH {BARS}, {STATES} SELECT symbol, ts, round(pct, 6) AS pct, state, CASE WHEN prev IS NOT NULL THEN prev || '>' || state END AS path1, CASE WHEN prev2 IS NOT NULL THEN prev2 || '>' || prev || '>' || state END AS path2 FROM tr")
def activity_states(spark, sf_dir):
    s = states(bars(spark, sf_dir))
    return s.select("symbol", "ts", r6("pct").alias("pct"), "state", (F.concat("prev", F.lit(">"), "state")).alias("path1"), F.concat("prev2", F.lit(">"), "prev", F.lit(">"), "state").alias("path2"))


@query(f"WITH {BARS}, {STATES} SELECT prev AS from_state, count(*) FILTER (state = 'QUIET') AS quiet, count(*) FILTER (state = 'NORMAL') AS normal, count(*) FILTER (state = 'ELEVATED') AS elevated, count(*) FILTER (state = 'EXTREME') AS extreme FROM tr WHERE prev IS NOT NULL AND prev <> 'UNKNOWN' GROUP BY prev")
def transition_matrix(spark, sf_dir):
    s = states(bars(spark, sf_dir)).where("prev IS NOT NULL AND prev <> 'UNKNOWN'")
    names = ["QUIET", "NORMAL", "ELEVATED", "EXTREME"]
    m = s.groupBy(F.col("prev").alias("from_state")).pivot("state", names).count().na.fill(0)
    return m.select("from_state", *[F.col(n).alias(n.lower()) for n in names])


@query(f"WITH {BARS}, c AS (SELECT symbol, ts FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN (SELECT DISTINCT ts FROM bars)), x AS (SELECT c.symbol, c.ts, b.ts IS NULL AS gone FROM c LEFT JOIN bars b USING (symbol, ts)), i AS (SELECT *, row_number() OVER ({S}) - row_number() OVER (PARTITION BY symbol, gone ORDER BY ts) AS g FROM x), r AS (SELECT symbol, g, count(*) AS n FROM i WHERE gone GROUP BY ALL) SELECT symbol, sum(n)::BIGINT AS missing_days, max(n) AS longest_run FROM r GROUP BY symbol")
def missing_day_runs(spark, sf_dir):
    """Market days without a bar, and the longest run of them, from the gaps between a symbol's bars' day numbers."""
    b = bars(spark, sf_dir).select("symbol", "ts")
    days = b.select("ts").distinct()
    numbered = days.withColumn("n", F.row_number().over(Window.orderBy("ts")))  # one row per market day
    total = numbered.agg(F.max("n").alias("last"))
    own = b.join(numbered, "ts")
    gap = own.select("symbol", "n", (F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("symbol").orderBy("n")), F.lit(0)) - 1).alias("gap"))
    per = gap.groupBy("symbol").agg(F.sum("gap").alias("g"), F.max("gap").alias("m"), F.max("n").alias("n"))
    tail = per.join(F.broadcast(total)).withColumn("end", F.col("last") - F.col("n"))
    return tail.select("symbol", (F.col("g") + F.col("end")).alias("missing_days"), F.greatest("m", "end").cast("long").alias("longest_run")).where("missing_days > 0")


@query(f"WITH {BARS}, a AS (SELECT *, avg(volume) OVER w AS v, count(volume) OVER w AS n FROM bars WINDOW w AS ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY round(v * close, 6) DESC, symbol) AS rk FROM a WHERE n = 20) SELECT ts, symbol, rk, round(v, 6) AS adv20 FROM r WHERE rk <= 10")
def liquid_set(spark, sf_dir):
    """The ten symbols a day with the largest trailing mean volume at the close's price."""
    w = trailing(20)
    a = bars(spark, sf_dir).select("symbol", "ts", "close", F.avg("volume").over(w).alias("v"), F.count("volume").over(w).alias("n")).where("n = 20")
    rk = F.row_number().over(Window.partitionBy("ts").orderBy(F.round(F.col("v") * F.col("close"), 6).desc(), "symbol"))
    return a.withColumn("rk", rk).where("rk <= 10").select("ts", "symbol", F.col("rk").cast("long").alias("rk"), r6("v").alias("adv20"))


@query(f"WITH {BARS} SELECT symbol, arg_max(ts, ts) AS ts, round(arg_max(close, ts), 6) AS close, arg_max(volume, ts) AS volume FROM bars GROUP BY symbol")
def features_latest(spark, sf_dir):
    """Last bar per symbol by a partial aggregate, not a sort."""
    last = bars(spark, sf_dir).groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "volume"), "ts").alias("r"))
    return last.select("symbol", "r.ts", r6("r.close").alias("close"), "r.volume")


@query(f"WITH {BARS} SELECT CASE WHEN close < 500 THEN 'low' WHEN close < 1500 THEN 'mid' ELSE 'high' END AS bucket, year(ts)::INT AS year, count(*) AS n, round(avg(high / nullif(low, 0) - 1), 6) AS mean_range FROM bars GROUP BY GROUPING SETS ((bucket, year), (bucket), (year), ())")
def grouping_report(spark, sf_dir):
    b = bars(spark, sf_dir).select(F.when(F.col("close") < 500, "low").when(F.col("close") < 1500, "mid").otherwise("high").alias("bucket"), F.year("ts").alias("year"), (F.try_divide("high", "low") - 1).alias("rng"))
    b.createOrReplaceTempView("grouping_report_rows")
    return spark.sql("SELECT bucket, year, count(*) AS n, round(avg(rng), 6) AS mean_range FROM grouping_report_rows GROUP BY GROUPING SETS ((bucket, year), (bucket), (year), ())")
