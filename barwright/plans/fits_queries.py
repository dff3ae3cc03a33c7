"""Fits over uneven times, paths of flow and price, and curves of recovery after shocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import near, near_sql
from ..operators.fits import SINGULAR, SPREAD, trailing_path_fits, window_fits
from ..operators.mechanisms import ramp
from ..operators.shocks import Rules, curves, shocks, tracked
from ..sources.tables import TAPE, TOUCHES, tape, touches
from .registry import query

PRINTS = f"{TAPE}, prints AS (SELECT symbol, event_id, CAST(floor(epoch_us(t) / 1000000) AS BIGINT) AS sec, value, k, CASE WHEN source IN ('click', 'purchase') THEN 1 ELSE -1 END AS side FROM tape)"
DAYS = 10
#: Sums of a group about its mean x and y, and the parabola's leading coefficient from them.
CENTRED = "x - avg(x) OVER (PARTITION BY symbol, event_id) AS u, y - avg(y) OVER (PARTITION BY symbol, event_id) AS v"
SUMS = "count(*) AS n, sum(u * u) AS m2, sum(u ** 3) AS m3, sum(u ** 4) AS m4, sum(u * v) AS uv, sum(u * u * v) AS uuv"
LEAD = f"CASE WHEN n >= 3 AND m2 * (m4 - m2 * m2 / n) - m3 * m3 > {SINGULAR} * m2 * m4 THEN (m2 * uuv - m3 * uv) / (m2 * (m4 - m2 * m2 / n) - m3 * m3) END"


def prints(spark, sf_dir):
    side = F.when(F.col("source").isin("click", "purchase"), 1).otherwise(-1)
    return tape(spark, sf_dir).select("symbol", "event_id", F.unix_seconds(F.col("t").cast("timestamp")).alias("sec"), "value", "k", side.alias("side"))


@query(f"""WITH {PRINTS}, j AS (SELECT a.symbol, a.event_id, (b.sec - a.sec) / 86400.0::DOUBLE AS x, b.value AS y FROM prints a JOIN prints b ON b.symbol = a.symbol AND b.sec <= a.sec AND b.sec >= a.sec - {DAYS * 86400}),
c AS (SELECT *, {CENTRED} FROM j), s AS (SELECT symbol, event_id, {SUMS}, count(DISTINCT x) AS times, count(DISTINCT y) AS kinds, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM c GROUP BY ALL)
SELECT symbol, event_id, n, CASE WHEN times >= 2 THEN floor(slope * 1e2 + 0.5) / 1e2 END AS slope, CASE WHEN m2 >= {(SPREAD * DAYS) ** 2} * n THEN floor(2 * ({LEAD}) * 1e3 + 0.5) / 1e3 END AS curvature, CASE WHEN times >= 2 AND kinds >= 2 THEN {near_sql('r2')} END AS r2 FROM s""")
def irregular_fits(spark, sf_dir):
    """Slope, curvature and fit of the value over the ten days behind each print, in days."""
    f = window_fits(prints(spark, sf_dir).select("symbol", "event_id", "value", "sec"), ["symbol"], "sec", "value", DAYS * 86400, unit=86400)
    rounded = lambda c, unit: (F.floor(F.col(c) * unit + 0.5) / unit).alias(c)  # noqa: E731  fewer digits, as prints seconds apart make steep slopes
    return f.select("symbol", "event_id", "n", rounded("slope", 1e2), rounded("curvature", 1e3), near("r2").alias("r2"))


LAST = 12
SQRT_LIKE = "least(greatest(1 - abs(exponent - 0.5) / 0.4, 0.0), 1.0)"
IMPACT = (
    f"{ramp('CAST(points AS DOUBLE)', 4.0, 10.0)} * {ramp('last_y', 0.5, 3.0)} * coalesce(power(CASE WHEN slope > 0 THEN {ramp('concavity', 0.3, 1.2)} ELSE 0.0 END * {SQRT_LIKE} * {ramp('r2', 0.5, 0.9)}, CAST(1 AS DOUBLE) / 3), 0.0)"
    f" * (0.6 + 0.4 * {ramp('abs(CAST(flow AS DOUBLE)) / nullif(total, 0)', 0.3, 0.8)})"
)


@query(f"""WITH {PRINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sec, event_id) AS rn FROM prints),
j AS (SELECT a.symbol, a.event_id, b.rn, b.value, b.side * b.k AS f, b.k, row_number() OVER (PARTITION BY a.symbol, a.event_id ORDER BY b.rn) AS i FROM r a JOIN r b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - {LAST - 1} AND a.rn),
d AS (SELECT symbol, event_id, sum(f) FILTER (i > 1) AS flow, sum(k) FILTER (i > 1) AS total, min_by(value, i) AS v0 FROM j GROUP BY ALL),
p AS (SELECT symbol, event_id, i, flow, total, sign(flow) * sum(CASE WHEN i > 1 THEN f ELSE 0 END) OVER (PARTITION BY symbol, event_id ORDER BY i) AS x, sign(flow) * (value - v0) AS y FROM j JOIN d USING (symbol, event_id)),
q AS (SELECT *, {CENTRED} FROM p),
s AS (SELECT symbol, event_id, any_value(flow) AS flow, any_value(total) AS total, {SUMS}, count(DISTINCT x) AS places, max_by(x, i) AS last_x, max_by(y, i) AS last_y, regr_slope(y, x) AS slope,
  count(*) FILTER (x > 0 AND y > 0) AS logs, regr_slope(ln(y), ln(x)) FILTER (x > 0 AND y > 0) AS b, regr_r2(ln(y), ln(x)) FILTER (x > 0 AND y > 0) AS br FROM q GROUP BY ALL),
c AS (SELECT symbol, event_id, n AS points, flow, total, last_y, CASE WHEN places >= 2 THEN slope END AS slope, CASE WHEN last_x > 0 AND last_y > 0 THEN -2 * ({LEAD}) * last_x * last_x / last_y END AS concavity,
  CASE WHEN logs >= 4 THEN b END AS exponent, CASE WHEN logs >= 4 THEN br END AS r2 FROM s WHERE flow <> 0)
SELECT symbol, event_id, points, {near_sql('exponent')} AS exponent, {near_sql('r2')} AS r2, {near_sql(IMPACT)} AS score, CASE WHEN {near_sql(IMPACT)} > 0 THEN sign(flow)::INT ELSE 0 END AS direction FROM c""")
def metaorder_impact(spark, sf_dir):
    """How much the value's path along the signed flow of the last twelve prints is a square root: exponent, fit and score."""
    p = prints(spark, sf_dir).select("symbol", "sec", "event_id", (F.col("side") * F.col("k")).alias("f"), "k", "value")
    c = trailing_path_fits(p, "symbol", ["sec", "event_id"], "f", "k", "value", LAST).withColumn("dir", F.signum("flow"))
    score = near(F.expr(IMPACT))
    return c.select("symbol", "event_id", "points", near("exponent").alias("exponent"), near("r2").alias("r2"), score.alias("score"), F.when(score > 0, F.col("dir").cast("int")).otherwise(0).alias("direction"))


#: In days, as the snapshots are.
RULES, DELAYS = Rules(burst=60, base=1500, timeout=900), [200, 400, 800]
PROGRESS = "(share_last - share_at_shock) / nullif(1 - share_at_shock, 0)"
RECOVERY = f"{ramp('CAST(points AS DOUBLE)', 3.0, 8.0)} * CASE WHEN tau IS NULL THEN 0.0 ELSE {ramp('fit_r2', 0.4, 0.85)} END * {ramp(f'(CASE WHEN share_at_shock < 1 THEN {PROGRESS} END)', 0.2, 0.7)}"
SHOCKS = f"""{TOUCHES}, o AS (SELECT symbol, dn::DOUBLE AS t, min(bd) AS d FROM touches GROUP BY ALL),
f AS (SELECT a.symbol, a.t, a.d, quantile_cont(b.d, 0.5) AS median, max_by(b.d, b.t) AS before FROM o a JOIN o b ON b.symbol = a.symbol AND b.t >= a.t - {RULES.base} AND b.t <= a.t - {RULES.burst} GROUP BY ALL HAVING count(*) >= {RULES.points}),
k AS (SELECT * FROM f WHERE median > 0 AND before - d >= {RULES.drop} * median AND d < {RULES.back} * median),
m AS (SELECT k.symbol, k.t, k.median, o.t - k.t AS s, o.d / k.median AS share FROM k JOIN o ON o.symbol = k.symbol AND o.t >= k.t AND o.t <= k.t + {RULES.timeout}),
e AS (SELECT *, min(s) FILTER (share >= {RULES.back} AND s > 0) OVER (PARTITION BY symbol, t) AS recovered_after FROM m),
g AS (SELECT symbol, t, median, recovered_after, count(*) AS points, min_by(share, s) AS share_at_shock, max_by(share, s) AS share_last, {', '.join(f'max_by(share, s) FILTER (s <= {d}) AS share_at_{d}' for d in DELAYS)}, max(share) > {RULES.over} AS overshoot,
  count(*) FILTER (share < 1) AS fitted, regr_slope(ln(1 - share), s) FILTER (share < 1) AS slope, regr_r2(ln(1 - share), s) FILTER (share < 1) AS r2
  FROM e WHERE recovered_after IS NULL OR s <= recovered_after GROUP BY ALL),
curve AS (SELECT *, t + coalesce(recovered_after, {RULES.timeout}) AS ended, CASE WHEN fitted >= 3 AND slope < -1e-12 THEN -1 / slope END AS tau, CASE WHEN fitted >= 3 AND slope < -1e-12 THEN r2 END AS fit_r2 FROM g)"""


def depths(spark, sf_dir):
    return touches(spark, sf_dir).groupBy("symbol", F.col("dn").alias("t")).agg(F.min("bd").alias("d"))


SHARES = ["share_at_shock", *[f"share_at_{d}" for d in DELAYS], "share_last", "tau"]


@query(f"WITH {SHOCKS} SELECT symbol, t::BIGINT AS dn, points, {', '.join(f'{near_sql(c)} AS {c}' for c in SHARES)}, recovered_after::BIGINT AS recovered_after, overshoot, {near_sql(RECOVERY)} AS score FROM curve")
def shock_curves(spark, sf_dir):
    """Every fall of the bid depth by half of its median, overlapping ones too: its way back at fixed delays, fitted and scored."""
    obs = depths(spark, sf_dir)
    c = curves(obs, shocks(obs, "symbol", "t", "d", RULES), "symbol", "t", "d", RULES, DELAYS)
    return c.select("symbol", F.col("t").cast("long").alias("dn"), "points", *[near(x).alias(x) for x in SHARES], F.col("recovered_after").cast("long").alias("recovered_after"), "overshoot", near(F.expr(RECOVERY)).alias("score"))


@query(f"""WITH RECURSIVE {SHOCKS}, nxt AS (SELECT c.symbol, c.t, min(d.t) AS after FROM curve c JOIN curve d ON d.symbol = c.symbol AND d.t >= c.ended GROUP BY ALL),
tr AS (SELECT symbol, min(t) AS t FROM curve GROUP BY symbol UNION ALL SELECT n.symbol, n.after FROM tr JOIN nxt n ON n.symbol = tr.symbol AND n.t = tr.t)
SELECT symbol, t::BIGINT AS dn, ended::BIGINT AS ended, recovered_after IS NOT NULL AS recovered, {near_sql(RECOVERY)} AS score FROM curve JOIN tr USING (symbol, t)""")
def shock_tracker(spark, sf_dir):
    """One shock of a symbol at a time: the next is looked for when the curve of the last has ended."""
    obs = depths(spark, sf_dir)
    c = tracked(curves(obs, shocks(obs, "symbol", "t", "d", RULES), "symbol", "t", "d", RULES, DELAYS), "symbol")
    return c.select("symbol", F.col("t").cast("long").alias("dn"), F.col("ended").cast("long").alias("ended"), F.col("recovered_after").isNotNull().alias("recovered"), near(F.expr(RECOVERY)).alias("score"))
