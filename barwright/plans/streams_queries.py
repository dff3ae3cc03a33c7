"""Streaming queries run to the end of their input; each equals a batch aggregate over the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import r6
from ..operators.shared import shared_folder as shared
from ..streaming import flow, silence
from .registry import query


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly_flow(spark, sf_dir):
    rows = flow.run_once(flow.hourly_flow(flow.read_tape(spark, sf_dir)), shared(spark), "update")
    last = rows.groupBy(F.col("w.start").alias("hour"), "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return last.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "r.n", "r.total")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY user_id")
def stream_symbol_state(spark, sf_dir):
    rows = flow.run_once(flow.latest_states(flow.read_tape(spark, sf_dir)), shared(spark), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "peak"), "batch").alias("r"))
    return last.select("user_id", "r.n", F.round("r.total", 4).alias("total"), "r.peak")


@query("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_first_receipts(spark, sf_dir):
    rows = flow.run_once(flow.first_receipts(flow.read_tape(spark, sf_dir)), shared(spark), "append")
    return rows.select("user_id", "event_type", F.col("hour").cast("timestamp_ntz").alias("hour"))


@query("SELECT a.event_id AS observation, b.event_id AS settlement, b.value FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_settlements(spark, sf_dir):
    rows = flow.run_once(flow.settled(flow.read_tape(spark, sf_dir)), shared(spark), "append")
    return rows.select("observation", "settlement", "value")


LATE, LIMIT = 5, 2
#: The watermark the run ends with; what comes after it is not settled yet.
END = f"(SELECT max(ts) - INTERVAL {LATE} DAY FROM events)"


@query(f"""WITH g AS (SELECT user_id AS symbol, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM (SELECT DISTINCT user_id, date_trunc('millisecond', ts) AS ts FROM events)),
e AS (SELECT date_trunc('millisecond', {END}) AS till)
SELECT symbol, before AS since, ts AS until FROM g, e WHERE ts - before > INTERVAL {LIMIT} DAY AND ts <= till
UNION ALL SELECT symbol, ts, NULL FROM g, e WHERE ts + INTERVAL {LIMIT} DAY < till AND (after IS NULL OR after > till)""")
def stream_silences(spark, sf_dir):
    """Silences of more than two days, by timers: with an end where a later event is there, without one where none came before the watermark."""
    rows = flow.run_once(silence.silences(flow.read_tape(spark, sf_dir), "user_id", LIMIT * 86_400_000, f"{LATE} days"), shared(spark), "append")
    stamp = lambda c: F.timestamp_millis(F.col(c)).cast("timestamp_ntz").alias(c)
    # What was reported open and ended later counts as ended.
    last = rows.groupBy("symbol", "since").agg(F.max("until").alias("until"))
    return last.select("symbol", stamp("since"), stamp("until"))
