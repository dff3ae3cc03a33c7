"""Statistical evaluation queries: conditional means, matched controls, tests and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, near, near_sql, r6, sums_before
from ..operators.quantiles import summed_up
from ..operators.shared import stored
from ..sources.tables import BARS, bars, table
from .registry import query

S = "PARTITION BY symbol ORDER BY ts"
#: A signal and its outcome: the day's range is wide, the close after five bars; strata by symbol class.
SIG = f"""{BARS}, y AS (SELECT symbol, ts, year(ts)::INT AS yr, high > low * 1.05 AS sig, trades, volume, lead(close, 5) OVER ({S}) / nullif(close, 0) - 1 AS out FROM bars), e AS (SELECT *, out > 0.1 AS hit FROM y WHERE out IS NOT NULL)"""


def evaluated(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir)
    y = b.select("symbol", "ts", F.year("ts").alias("yr"), (F.col("high") > F.col("low") * 1.05).alias("sig"), "trades", "volume", (F.try_divide(F.lead("close", 5).over(by_symbol()), F.col("close")) - 1).alias("out"))
    return y.where("out IS NOT NULL").withColumn("hit", F.col("out") > 0.1)


@query(f"WITH {SIG} SELECT sig, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(avg(out), 6) AS mean, round(quantile_cont(out, 0.5), 6) AS median, round(quantile_cont(out, 0.05), 6) AS p05, round(avg(out) / (stddev_samp(out) / sqrt(count(*))), 5) AS t FROM e GROUP BY sig")
def signal_rows(spark, sf_dir):
    t = F.avg("out") / (F.stddev_samp("out") / F.sqrt(F.count("*")))
    sums = F.count("*").alias("n"), r6(F.avg(F.col("hit").cast("int"))).alias("hit_rate"), r6(F.avg("out")).alias("mean"), F.round(t, 5).alias("t")
    with stored(evaluated(spark, sf_dir).select("sig", "out", "hit")) as e:
        g = summed_up(e, ["sig"], "out", {"median": 0.5, "p05": 0.05}, *sums)
    return g.select("sig", "n", "hit_rate", "mean", r6("median").alias("median"), r6("p05").alias("p05"), "t")


@query(f"WITH {SIG}, d AS (SELECT sig, ts, avg(out) AS m FROM e GROUP BY ALL) SELECT sig, count(*) AS days, round(avg(m), 6) AS mean, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 5) AS t FROM d GROUP BY sig")
def clustered_t(spark, sf_dir):
    """Mean per date first, then a t statistic over dates."""
    d = evaluated(spark, sf_dir).groupBy("sig", "ts").agg(F.avg("out").alias("m"))
    return d.groupBy("sig").agg(F.count("*").alias("days"), r6(F.avg("m")).alias("mean"), F.round(F.avg("m") / (F.stddev_samp("m") / F.sqrt(F.count("*"))), 5).alias("t"))


@query(f"WITH {SIG} SELECT symbol, ts, round((sum(out) OVER w - out) / (count(*) OVER w - 1), 6) AS loo_mean FROM e WINDOW w AS (PARTITION BY ts, trades) QUALIFY count(*) OVER w > 1")
def loo_base(spark, sf_dir):
    """Mean outcome of the other bars in the same stratum."""
    e = evaluated(spark, sf_dir)
    w = Window.partitionBy("ts", "trades")
    x = e.select("symbol", "ts", F.count("*").over(w).alias("n"), (F.sum("out").over(w) - F.col("out")).alias("rest")).where("n > 1")
    return x.select("symbol", "ts", r6(F.col("rest") / (F.col("n") - 1)).alias("loo_mean"))


@query(f"WITH {SIG}, c AS (SELECT yr, trades, count(*) AS n, avg(hit::INT) AS p FROM e WHERE NOT sig GROUP BY ALL), s AS (SELECT yr, trades, count(*) AS n, avg(hit::INT) AS p FROM e WHERE sig GROUP BY ALL) SELECT sum(s.n)::BIGINT AS matched, round(sum(s.n * s.p) / sum(s.n), 6) AS p_signal, round(sum(s.n * c.p) / sum(s.n), 6) AS p_control, round(sum(s.n * s.p) / nullif(sum(s.n * c.p), 0), 6) AS lift FROM s JOIN c USING (yr, trades)")
def matched_controls(spark, sf_dir):
    """Expected outcome of controls drawn from the signal rows' own cells (year, trades), in closed form."""
    cells = evaluated(spark, sf_dir).groupBy("yr", "trades").agg(
        F.count_if("sig").alias("n"), F.avg(F.when(F.col("sig"), F.col("hit").cast("int"))).alias("ps"), F.avg(F.when(~F.col("sig"), F.col("hit").cast("int"))).alias("pc")
    ).where("n > 0 AND pc IS NOT NULL")
    hits, base = F.sum(F.col("n") * F.col("ps")), F.sum(F.col("n") * F.col("pc"))
    return cells.agg(F.sum("n").alias("matched"), r6(hits / F.sum("n")).alias("p_signal"), r6(base / F.sum("n")).alias("p_control"), r6(F.try_divide(hits, base)).alias("lift"))


#: Coefficients of a Chebyshev fit of erfc with a relative error below 1.2e-7 (fixed values).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_p_sql(t: str) -> str:
    """Two-sided normal tail of a t value: erfc(|t| / sqrt 2), the same text on both engines."""
    x = f"(abs({t}) / sqrt(CAST(2 AS DOUBLE)))"
    u, inner = f"(1 / (1 + {x} / 2))", "0.0"
    for c in reversed(ERFC):
        inner = f"CAST({c} AS DOUBLE) + {u} * ({inner})" if inner != "0.0" else f"CAST({c} AS DOUBLE)"
    return f"({u} * exp(-{x} * {x} + ({inner})))"


TESTS = f"{SIG}, p AS (SELECT yr, trades, avg(out) / nullif(stddev_samp(out) / sqrt(count(*)), 0) AS t FROM e GROUP BY ALL HAVING count(*) >= 20), q AS (SELECT yr, trades, round({two_sided_p_sql("t")}, 7) AS p FROM p WHERE t IS NOT NULL)"


@query(f"WITH {TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, yr, trades) AS k, count(*) OVER () AS m FROM q) SELECT yr, trades, p, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value, k <= coalesce((SELECT max(k) FROM r WHERE p <= 0.05 * k / m), 0) AS keep FROM r")
def bh_fdr(spark, sf_dir):
    """Benjamini-Hochberg q-values and keep mask over a family of tests, one row per test."""
    e = evaluated(spark, sf_dir).groupBy("yr", "trades").agg(F.count("*").alias("n"), F.try_divide(F.avg("out"), F.stddev_samp("out") / F.sqrt(F.count("*"))).alias("t")).where("n >= 20 AND t IS NOT NULL")
    q = e.select("yr", "trades", F.round(F.expr(two_sided_p_sql("t")), 7).alias("p"))
    family, order = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("p", "yr", "trades")
    r = q.withColumn("k", F.row_number().over(order)).withColumn("m", F.count("*").over(family))
    top = F.max(F.when(F.col("p") <= 0.05 * F.col("k") / F.col("m"), F.col("k"))).over(family)
    adjusted = F.min(F.col("p") * F.col("m") / F.col("k")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return r.select("yr", "trades", "p", r6(F.least(F.lit(1.0), adjusted)).alias("q_value"), (F.col("k") <= F.coalesce(top, F.lit(0))).alias("keep"))


@query(f"""WITH {SIG}, d AS (SELECT ts, avg(out) AS x FROM e WHERE sig GROUP BY ts), c AS (SELECT row_number() OVER (ORDER BY ts) AS i, x - (SELECT avg(x) FROM d) AS u FROM d), n AS (SELECT count(*) AS n FROM d),
g AS (SELECT l, (SELECT sum(a.u * b.u) FROM c a JOIN c b ON a.i = b.i + l) / (SELECT n FROM n) AS gamma FROM range(0, 6) r(l)), v AS (SELECT sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / 6.0) * gamma END) AS s FROM g)
SELECT (SELECT n FROM n) AS n, round((SELECT avg(x) FROM d), 6) AS mean, round((SELECT avg(x) FROM d) / sqrt(s / (SELECT n FROM n)), 4) AS nw_t FROM v""")
def newey_west_t(spark, sf_dir):
    """Mean of a daily series with a Newey-West error of five lags: one row per date, autocovariances by lag."""
    d = evaluated(spark, sf_dir).where("sig").groupBy("ts").agg(F.avg("out").alias("x"))
    one = Window.partitionBy(F.lit(1))
    c = d.withColumn("u", F.col("x") - F.avg("x").over(one))
    lags = [F.lag("u", k).over(one.orderBy("ts")).alias(f"u{k}") for k in range(1, 6)]
    s = c.select("x", "u", *lags).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum(F.col("u") * F.col("u")).alias("g0"), *[F.sum(F.col("u") * F.col(f"u{k}")).alias(f"g{k}") for k in range(1, 6)])
    var = F.col("g0") + sum(2 * (1 - k / 6.0) * F.col(f"g{k}") for k in range(1, 6))
    return s.select("n", r6("mean").alias("mean"), F.round(F.col("mean") / F.sqrt(var / F.col("n") / F.col("n")), 4).alias("nw_t"))


LAB = "x AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {LAB}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM x) SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc FROM r")
def auc(spark, sf_dir):
    """Mann-Whitney AUC with half credit for ties, from counts per distinct score."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")
    per = x.groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("q"))
    won = F.col("p") * (F.col("below") + F.col("q") / 2)
    s = sums_before(per, "score", {"below": "q"}).select("p", "q", won.alias("won")).agg(F.sum("p").alias("n1"), F.sum("q").alias("n0"), F.sum("won").alias("won"))
    return s.select("n1", "n0", r6(F.try_divide("won", F.col("n1") * F.col("n0"))).alias("auc"))


@query(f"WITH {SIG}, r AS (SELECT yr, rank() OVER (PARTITION BY yr ORDER BY volume) + (count(*) OVER (PARTITION BY yr, volume) - 1) / 2.0 AS a, rank() OVER (PARTITION BY yr ORDER BY round(out, 9)) + (count(*) OVER (PARTITION BY yr, round(out, 9)) - 1) / 2.0 AS b FROM e) SELECT yr, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY yr")
def spearman(spark, sf_dir):
    """Rank correlation of volume and outcome per year."""
    e = evaluated(spark, sf_dir).withColumn("o", F.round("out", 9))

    def ranked(column: str, name: str) -> DataFrame:
        """Mean rank of each distinct value, from the counts of smaller ones."""
        counts = e.groupBy("yr", column).agg(F.count("*").alias("n"))
        return sums_before(counts, column, {"below": "n"}, ["yr"]).select("yr", column, (F.col("below") + (F.col("n") + 1) / 2).alias(name))

    return e.select("yr", "volume", "o").join(ranked("volume", "a"), ["yr", "volume"]).join(ranked("o", "b"), ["yr", "o"]).groupBy("yr").agg(F.count("*").alias("n"), r6(F.corr("a", "b")).alias("rho"))


@query(f"WITH {SIG}, r AS (SELECT out, hit, yr, greatest(ceil((row_number() OVER (PARTITION BY yr ORDER BY volume, symbol, ts) - 1) * 10.0 / nullif(count(*) OVER (PARTITION BY yr) - 1, 0)) - 1, 0)::INT AS decile FROM e) SELECT decile, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(avg(out), 6) AS mean FROM r GROUP BY decile")
def decile_response(spark, sf_dir):
    """Response by tenth of volume within the year (ranked, ties by symbol and day)."""
    e = evaluated(spark, sf_dir)
    counts = e.groupBy("yr", "volume").agg(F.count("*").alias("here"))
    placed = sums_before(counts, "volume", {"below": "here"}, ["yr"]).join(counts.groupBy("yr").agg(F.sum("here").alias("n")), "yr")
    e = e.join(placed.drop("here"), ["yr", "volume"])
    rn, n = F.col("below") + F.row_number().over(Window.partitionBy("yr", "volume").orderBy("symbol", "ts")), F.col("n")
    d = e.withColumn("decile", F.greatest(F.ceil(F.try_divide((rn - 1) * F.lit(10.0), n - 1)) - 1, F.lit(0)).cast("int"))
    return d.groupBy("decile").agg(F.count("*").alias("n"), r6(F.avg(F.col("hit").cast("int"))).alias("hit_rate"), r6(F.avg("out")).alias("mean"))


@query(f"WITH {SIG}, r AS (SELECT symbol, sig, hit, row_number() OVER ({S}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM e), s AS (SELECT a.symbol, a.sig, b.hit FROM r a JOIN r b ON a.symbol = b.symbol AND b.i = (a.i + 37 + a.symbol) % a.n) SELECT (SELECT round(avg(hit::INT), 6) FROM r WHERE sig) AS observed, round(avg(hit::INT) FILTER (sig), 6) AS shifted FROM s")
def circular_shift(spark, sf_dir):
    """One draw of the permutation null: each symbol's outcomes turned by an offset of its own."""
    e = evaluated(spark, sf_dir)
    r = e.select("symbol", "sig", "hit", (F.row_number().over(by_symbol()) - 1).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    signals = r.select("symbol", "sig", ((F.col("i") + 37 + F.col("symbol")) % F.col("n")).cast("int").alias("i"))
    j = signals.join(r.select("symbol", "i", "hit"), ["symbol", "i"])
    shifted = j.agg(r6(F.avg(F.when(F.col("sig"), F.col("hit").cast("int")))).alias("shifted"))
    return r.agg(r6(F.avg(F.when(F.col("sig"), F.col("hit").cast("int")))).alias("observed")).join(shifted)


#: Distribution function of Poisson(1) at 0 to 5 (fixed values).
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
#: Bars of a block and replicates.
BARS_A_BLOCK, DRAWS = 40, 200
HEAVY = " + ".join(f"(u > {c})::INT" for c in POISSON)


@query(f"""WITH {SIG}, k AS (SELECT *, (row_number() OVER ({S}) - 1) // {BARS_A_BLOCK} AS block FROM e), b AS (SELECT symbol, block, count(*) AS n, sum(hit::INT) AS h, sum(sig::INT) AS ns, sum((sig AND hit)::INT) AS hs FROM k GROUP BY ALL),
d AS (SELECT b.*, draw, ('0x' || substr(md5(concat_ws(':', draw, symbol, block)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b, range(1, {DRAWS + 1}) r(draw)), w AS (SELECT *, {HEAVY} AS w FROM d),
l AS (SELECT draw, (sum(w * hs) / nullif(sum(w * ns), 0)::DOUBLE) / nullif(sum(w * h) / nullif(sum(w * n), 0)::DOUBLE, 0) AS lift FROM w GROUP BY draw)
SELECT count(lift) AS draws, {near_sql('quantile_cont(lift, 0.05)')} AS low, {near_sql('quantile_cont(lift, 0.5)')} AS mid, {near_sql('quantile_cont(lift, 0.95)')} AS high FROM l""")
def block_bootstrap(spark, sf_dir):
    """90 % interval of the lift over 200 replicates: blocks of forty bars weighted by Poisson draws from seeded hashes.

    Blocks are summed first, and a block's replicates are explodes of its few sums.
    """
    e = evaluated(spark, sf_dir).withColumn("block", F.floor((F.row_number().over(by_symbol()) - 1) / BARS_A_BLOCK))
    hit = F.col("hit").cast("int")
    blocks = e.groupBy("symbol", "block").agg(F.count("*").alias("n"), F.sum(hit).alias("h"), F.sum(F.col("sig").cast("int")).alias("ns"), F.sum(F.when(F.col("sig"), hit).otherwise(0)).alias("hs"))
    draws = blocks.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "symbol", "block")), 1, 8), 16, 10).cast("long") / 4294967296.0
    weight = sum((u > c).cast("int") for c in POISSON)
    w = draws.withColumn("w", weight).groupBy("draw").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "h", "ns", "hs")])
    lift = w.select(F.try_divide(F.col("hs"), F.col("ns")).alias("a"), F.try_divide(F.col("h"), F.col("n")).alias("b")).select(F.try_divide("a", "b").alias("lift"))
    return lift.agg(F.count("lift").alias("draws"), near(F.percentile("lift", 0.05)).alias("low"), near(F.percentile("lift", 0.5)).alias("mid"), near(F.percentile("lift", 0.95)).alias("high"))


@query(f"""WITH {SIG}, s AS (SELECT symbol, count(*) FILTER (sig) AS n FROM e GROUP BY symbol), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, symbol) AS k FROM s)
SELECT sum(n)::BIGINT AS fires, round(sum(n) FILTER (k <= 3) / nullif(sum(n), 0)::DOUBLE, 6) AS top3_share FROM r""")
def top3_share(spark, sf_dir):
    """Share of the three symbols that fire most, by a global top-3 instead of a full sort."""
    s = evaluated(spark, sf_dir).groupBy("symbol").agg(F.count_if("sig").alias("n"))
    top = s.orderBy(F.desc("n"), "symbol").limit(3).agg(F.sum("n").alias("top"))
    return s.agg(F.sum("n").alias("fires")).join(top).select("fires", r6(F.try_divide(F.col("top").cast("double"), F.col("fires"))).alias("top3_share"))


FP = "f AS (SELECT symbol, ts, high > low * 1.05 AS a, trades >= 2 AS b, volume > 40 AS c FROM bars)"


@query(f"WITH {BARS}, {FP}, l AS (SELECT symbol, ts, 'a' AS fp FROM f WHERE a UNION ALL SELECT symbol, ts, 'b' FROM f WHERE b UNION ALL SELECT symbol, ts, 'c' FROM f WHERE c), n AS (SELECT fp, count(*) AS n FROM l GROUP BY fp), p AS (SELECT x.fp AS i, y.fp AS j, count(*) AS n_both FROM l x JOIN l y ON x.symbol = y.symbol AND x.ts = y.ts AND x.fp < y.fp GROUP BY ALL) SELECT i, j, n_both, round(n_both / (ni.n + nj.n - n_both)::DOUBLE, 6) AS jaccard FROM p JOIN n ni ON ni.fp = i JOIN n nj ON nj.fp = j")
def footprint_overlap(spark, sf_dir):
    """Pairwise overlap of footprints: each bar explodes its own few pairs, so there is no self join."""
    b = bars(spark, sf_dir)
    fired = F.filter(F.array(F.when(F.col("high") > F.col("low") * 1.05, "a"), F.when(F.col("trades") >= 2, "b"), F.when(F.col("volume") > 40, "c")), lambda x: x.isNotNull())
    f = b.select(fired.alias("f"))
    pairs = F.flatten(F.transform("f", lambda x: F.transform(F.filter("f", lambda y: y >= x), lambda y: F.struct(x.alias("i"), y.alias("j")))))
    n = f.select(F.inline(pairs)).groupBy("i", "j").agg(F.count("*").alias("n_both"))
    own = n.where("i = j").select(F.col("i").alias("k"), F.col("n_both").alias("n"))
    x = n.where("i < j").join(F.broadcast(own.withColumnRenamed("n", "ni")), F.col("i") == F.col("k")).drop("k").join(F.broadcast(own.withColumnRenamed("n", "nj")), F.col("j") == F.col("k"))
    return x.select("i", "j", "n_both", r6(F.col("n_both") / (F.col("ni") + F.col("nj") - F.col("n_both"))).alias("jaccard"))


@query(f"WITH {SIG}, k AS (SELECT *, row_number() OVER ({S}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM e), s AS (SELECT *, CASE WHEN rn <= floor(0.4 * n) THEN 'dev' WHEN rn <= floor(0.7 * n) THEN 'val' ELSE 'holdout' END AS split FROM k) SELECT split, sig, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate FROM s GROUP BY ALL")
def chronological_splits(spark, sf_dir):
    e = evaluated(spark, sf_dir)
    rn, n = F.row_number().over(by_symbol()), F.count("*").over(Window.partitionBy("symbol"))
    split = F.when(rn <= F.floor(0.4 * n), "dev").when(rn <= F.floor(0.7 * n), "val").otherwise("holdout")
    return e.withColumn("split", split).groupBy("split", "sig").agg(F.count("*").alias("n"), r6(F.avg(F.col("hit").cast("int"))).alias("hit_rate"))


@query(f"WITH {SIG}, t AS (SELECT sum((sig AND hit)::INT) AS hs, sum(sig::INT) AS ns FROM e), s AS (SELECT symbol, sum((sig AND hit)::INT) AS hs, sum(sig::INT) AS ns FROM e GROUP BY symbol) SELECT s.symbol, round((t.hs - s.hs) / nullif(t.ns - s.ns, 0)::DOUBLE, 6) AS hit_rate_without FROM s, t")
def leave_one_symbol_out(spark, sf_dir):
    """Hit rate without each symbol, as totals less the symbol's sums: no loop over symbols."""
    e = evaluated(spark, sf_dir)
    s = e.groupBy("symbol").agg(F.count_if(F.col("sig") & F.col("hit")).alias("hs"), F.count_if("sig").alias("ns"))
    t = s.agg(F.sum("hs").alias("ths"), F.sum("ns").alias("tns"))  # one row
    return s.join(F.broadcast(t)).select("symbol", r6(F.try_divide((F.col("ths") - F.col("hs")).cast("double"), F.col("tns") - F.col("ns"))).alias("hit_rate_without"))


@query(f"""WITH {SIG}, v AS (SELECT volume AS x, count(*) AS n, sum(hit::INT) AS h FROM e GROUP BY volume), c AS (SELECT x, sum(n) OVER w AS n1, sum(h) OVER w AS h1, sum(n) OVER () AS n, sum(h) OVER () AS h FROM v WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
b AS (SELECT x, n1, CASE WHEN n1 < n THEN (CASE WHEN h1 > 0 AND h1 < n1 THEN -(h1 * log2(h1 / n1::DOUBLE) + (n1 - h1) * log2((n1 - h1) / n1::DOUBLE)) ELSE 0 END) + (CASE WHEN h - h1 > 0 AND h - h1 < n - n1 THEN -((h - h1) * log2((h - h1) / (n - n1)::DOUBLE) + (n - n1 - h + h1) * log2((n - n1 - h + h1) / (n - n1)::DOUBLE)) ELSE 0 END) END AS bits FROM c)
SELECT x AS cut, n1::BIGINT AS below, round(bits, 4) AS bits FROM b WHERE bits IS NOT NULL ORDER BY round(bits, 4), x LIMIT 1""")
def best_numeric_split(spark, sf_dir):
    """The cut of volume that codes the outcome in the fewest bits, from prefix counts over distinct values."""
    v = evaluated(spark, sf_dir).groupBy(F.col("volume").alias("x")).agg(F.count("*").alias("n0"), F.count_if("hit").alias("h0"))
    total = v.agg(F.sum("n0").alias("n"), F.sum("h0").alias("h"))  # one row
    c = sums_before(v, "x", {"n_": "n0", "h_": "h0"}).join(F.broadcast(total))
    c = c.select("x", (F.col("n_") + F.col("n0")).alias("n1"), (F.col("h_") + F.col("h0")).alias("h1"), "n", "h")

    def code(n, h):
        part = lambda k: k * F.log2(k / n)
        return F.when((h > 0) & (h < n), -(part(h) + part(n - h))).otherwise(0.0)

    n, h, n1, h1 = (F.col(x) for x in ("n", "h", "n1", "h1"))
    b = c.where("n1 < n").select(F.col("x").alias("cut"), n1.alias("below"), F.round(code(n1, h1) + code(n - n1, h - h1), 4).alias("bits"))
    return b.orderBy("bits", "cut").limit(1)


@query(f"""WITH {SIG}, g AS (SELECT symbol, count(*) FILTER (sig) AS n, avg(out) FILTER (sig) AS m FROM e GROUP BY symbol) SELECT symbol, n, CASE WHEN n < 10 THEN 'BLOCKED' WHEN m > 0.5 THEN 'KEEP' ELSE 'KILL' END AS verdict FROM g""")
def verdicts(spark, sf_dir):
    g = evaluated(spark, sf_dir).groupBy("symbol").agg(F.count_if("sig").alias("n"), F.avg(F.when(F.col("sig"), F.col("out"))).alias("m"))
    return g.select("symbol", "n", F.when(F.col("n") < 10, "BLOCKED").when(F.col("m") > 0.5, "KEEP").otherwise("KILL").alias("verdict"))
