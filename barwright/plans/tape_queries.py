"""Queries over event tapes: deduplication, interval flow, pressure, episodes, hashes, consensus, identity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import r6
from ..operators.asof import seconds
from ..operators.sequential import cooldown
from ..sources.tables import TAPE, table, tape
from .registry import query

W = "PARTITION BY symbol ORDER BY t, event_id"


def ordered():
    return Window.partitionBy("symbol").orderBy("t", "event_id")


@query(f"WITH {TAPE}, d AS (SELECT symbol, k, source, min_by(event_id, (epoch_us(t), event_id)) AS first_event, count(*) AS pulls_seen FROM tape GROUP BY ALL) SELECT * FROM d".replace("min_by(event_id, (epoch_us(t), event_id))", "(list(event_id ORDER BY t, event_id))[1]"))
def tape_dedup(spark, sf_dir):
    """First receipt of each (symbol, k, source), and how often it was seen; a partial aggregate per key."""
    t = tape(spark, sf_dir)
    return t.groupBy("symbol", "k", "source").agg(F.min(F.struct("t", "event_id"))["event_id"].alias("first_event"), F.count("*").alias("pulls_seen"))


@query(f"WITH {TAPE}, c AS (SELECT *, sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER ({W}) AS n FROM tape) SELECT symbol, event_id, n AS cum_trades, round(cum, 4) AS cum_volume, round(cum - coalesce(lag(cum) OVER ({W}), 0), 4) AS interval_volume, CASE WHEN value > lag(value) OVER ({W}) THEN 1 WHEN value < lag(value) OVER ({W}) THEN -1 ELSE 0 END AS tick FROM c")
def interval_tape(spark, sf_dir):
    """Running totals and what each print adds to them, with the tick's direction."""
    w = ordered()
    c = tape(spark, sf_dir).withColumn("cum", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tick = F.coalesce(F.signum(F.col("value") - F.lag("value").over(w)), F.lit(0.0)).cast("int")
    return c.select("symbol", "event_id", F.row_number().over(w).cast("long").alias("cum_trades"), F.round("cum", 4).alias("cum_volume"), F.round(F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0.0)), 4).alias("interval_volume"), tick.alias("tick"))


@query(f"WITH {TAPE}, m AS (SELECT *, avg(CASE WHEN source IN ('click', 'purchase') THEN value ELSE -value END) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p, count(*) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM tape) SELECT symbol, event_id, CASE WHEN n = 5 THEN round(p, 6) END AS pressure, CASE WHEN n < 5 THEN 'UNKNOWN' WHEN p > 20 THEN 'BUY' WHEN p < -20 THEN 'SELL' ELSE 'NEUTRAL' END AS reading FROM m")
def analyze_pressure(spark, sf_dir):
    w = ordered().rowsBetween(-4, 0)
    signed = F.when(F.col("source").isin("click", "purchase"), F.col("value")).otherwise(-F.col("value"))
    m = tape(spark, sf_dir).select("symbol", "event_id", F.avg(signed).over(w).alias("p"), F.count("*").over(w).alias("n"))
    return m.select("symbol", "event_id", F.when(F.col("n") == 5, r6("p")).alias("pressure"), F.when(F.col("n") < 5, "UNKNOWN").when(F.col("p") > 20, "BUY").when(F.col("p") < -20, "SELL").otherwise("NEUTRAL").alias("reading"))


@query(f"""WITH RECURSIVE {TAPE}, s AS (SELECT symbol, event_id, epoch_us(t) / 1e6 AS sec, row_number() OVER (PARTITION BY symbol ORDER BY t, event_id) AS n FROM tape WHERE value > 60),
r AS (SELECT symbol, event_id, sec, n, sec AS kept, true AS keep FROM s WHERE n = 1 UNION ALL
  SELECT s.symbol, s.event_id, s.sec, s.n, CASE WHEN s.sec - r.kept >= 86400 THEN s.sec ELSE r.kept END, s.sec - r.kept >= 86400 FROM r JOIN s ON s.symbol = r.symbol AND s.n = r.n + 1)
SELECT symbol, event_id FROM r WHERE keep""")
def episodes(spark, sf_dir):
    """Large prints at least a day after the last kept one of their symbol."""
    big = tape(spark, sf_dir).where("value > 60").select("symbol", "event_id", seconds(F.col("t")).alias("at"))
    return cooldown(big, "symbol", "at", 86400.0).select("symbol", "event_id")


@query(f"""WITH {TAPE}, h AS (SELECT symbol, date_trunc('day', t) AS day, max(value) AS hi, min(value) AS lo, count(DISTINCT source) AS sources, count(*) AS n FROM tape GROUP BY ALL) SELECT symbol, CAST(day AS DATE) AS day, sources, n, round(hi - lo, 6) AS spread, hi - lo <= 20 AND sources > 1 AS agree FROM h""")
def reconcile(spark, sf_dir):
    """Agreement of sources per symbol and day within a tolerance; nothing is averaged."""
    h = tape(spark, sf_dir).groupBy("symbol", F.to_date("t").alias("day")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.countDistinct("source").alias("sources"), F.count("*").alias("n"))
    return h.select("symbol", "day", "sources", "n", r6(F.col("hi") - F.col("lo")).alias("spread"), ((F.col("hi") - F.col("lo") <= 20) & (F.col("sources") > 1)).alias("agree"))


@query(f"WITH {TAPE}, s AS (SELECT symbol, max(CASE WHEN source = 'signup' THEN k END) AS a, count(DISTINCT k) FILTER (source = 'view') AS v, min(k) FILTER (source = 'view') AS first FROM tape GROUP BY symbol) SELECT symbol, a AS signup_k, CASE WHEN v = 1 THEN first END AS view_k, CASE WHEN v = 1 THEN 'OBSERVED' WHEN v > 1 THEN 'CONFLICT' ELSE 'MISSING' END AS view_status FROM s")
def identity_spine(spark, sf_dir):
    """Attributes claimed per symbol: one value is observed, several are withheld as a conflict."""
    view = F.when(F.col("source") == "view", F.col("k"))
    s = tape(spark, sf_dir).groupBy("symbol").agg(F.max(F.when(F.col("source") == "signup", F.col("k"))).alias("a"), F.countDistinct(view).alias("v"), F.min(view).alias("first"))
    return s.select("symbol", F.col("a").alias("signup_k"), F.when(F.col("v") == 1, F.col("first")).alias("view_k"), F.when(F.col("v") == 1, "OBSERVED").when(F.col("v") > 1, "CONFLICT").otherwise("MISSING").alias("view_status"))


@query(f"WITH {TAPE}, h AS (SELECT symbol, event_id, t, sha256(symbol || '|' || event_id || '|' || source) AS sha FROM tape) SELECT symbol, event_id, sha, lag(sha) OVER ({W}) AS prev_sha FROM h")
def hash_links(spark, sf_dir):
    """Each record's hash and its predecessor's, the links a store's chain is verified by."""
    h = tape(spark, sf_dir).withColumn("sha", F.sha2(F.concat_ws("|", F.col("symbol").cast("string"), F.col("event_id").cast("string"), "source"), 256))
    return h.select("symbol", "event_id", "sha", F.lag("sha").over(ordered()).alias("prev_sha"))


@query(f"WITH {TAPE}, d AS (SELECT DISTINCT symbol, source FROM tape), u AS (SELECT count(DISTINCT symbol) AS n FROM tape) SELECT source, count(*) AS symbols, (SELECT n FROM u) - count(*) AS missing FROM d GROUP BY source")
def source_coverage(spark, sf_dir):
    t = tape(spark, sf_dir)
    n = t.agg(F.countDistinct("symbol").alias("u"))
    per = t.groupBy("source").agg(F.countDistinct("symbol").alias("symbols"))
    return per.join(F.broadcast(n)).select("source", "symbols", (F.col("u") - F.col("symbols")).alias("missing"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS links FROM pages) SELECT page_id, title, len(links)::BIGINT AS n_links, links[1] AS first_link FROM p""")
def page_tables(spark, sf_dir):
    """Title and list links of raw pages, whole documents, by expressions instead of a parser per row."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1)).alias("links"))
    return p.select("page_id", "title", F.size("links").cast("long").alias("n_links"), F.get("links", F.lit(0)).alias("first_link"))


@query(f"WITH {TAPE} SELECT event_id, CASE WHEN dayofweek(t + INTERVAL 6 HOUR) IN (5, 6) THEN 'CLOSED' WHEN hour(t + INTERVAL 6 HOUR) * 60 + minute(t + INTERVAL 6 HOUR) BETWEEN 600 AND 869 THEN 'CONTINUOUS' WHEN hour(t + INTERVAL 6 HOUR) * 60 + minute(t + INTERVAL 6 HOUR) BETWEEN 570 AND 599 THEN 'PRE_OPEN' ELSE 'CLOSED' END AS phase, CAST(t + INTERVAL 6 HOUR AS DATE) AS trading_date FROM tape")
def session_phase(spark, sf_dir):
    """Session phase in the market's own zone, six hours ahead; Friday and Saturday are closed."""
    local = F.col("t") + F.expr("INTERVAL 6 HOURS")
    minute = F.hour(local) * 60 + F.minute(local)
    phase = F.when(F.dayofweek(local).isin(6, 7), "CLOSED").when(minute.between(600, 869), "CONTINUOUS").when(minute.between(570, 599), "PRE_OPEN").otherwise("CLOSED")
    return tape(spark, sf_dir).select("event_id", phase.alias("phase"), F.to_date(local).alias("trading_date"))
