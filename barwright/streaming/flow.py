"""Structured Streaming jobs over the event tape."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern, since the table may be one file or a folder of them.
    stream = spark.readStream.schema(schema)
    return stream.parquet(f"{sf_dir}/events[.]parquet").withColumn("t", F.col("ts").cast("timestamp"))


def hourly_flow(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums per hour and event type; hours close ``late`` after the latest event time seen."""
    return events.withWatermark("t", late).groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


STATE, OUT = "n long, total double, peak double", "user_id long, n long, total double, peak double"


def symbol_state(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Running count, sum and peak of one symbol; the state is three numbers."""
    n, total, peak = state.get if state.exists else (0, 0.0, float("-inf"))
    for b in batches:
        n, total, peak = n + len(b), total + float(b["value"].sum()), max(peak, float(b["value"].max()))
    state.update((n, total, peak))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "peak": [peak]})


def latest_states(events: DataFrame) -> DataFrame:
    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(symbol_state, OUT, STATE, "update", "NoTimeout")


def run_once(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what is there, into Parquet below ``folder``."""
    return run_into(stream, f"{folder}/stream-{uuid.uuid4().hex}", mode)


def run_into(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what it hasn't seen yet, by its checkpoint below ``name``; all rows that it has ever written there.

    Each batch is written whole, then named by its id, so a batch that is run again replaces itself.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{name}/rows/batch_{number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{name}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{name}/rows")


def first_receipts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """First event per user, type and hour; the keys that are remembered end with the watermark."""
    keyed = events.withWatermark("t", late).withColumn("hour", F.date_trunc("hour", "t"))
    return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"]).select("user_id", "event_type", "hour")


def settled(events: DataFrame, within: str = "1 day") -> DataFrame:
    """Clicks joined to purchases of the same user within a day after: both sides' state ends with their watermarks."""
    late = events.withWatermark("t", "1 hour")
    a = late.where("event_type = 'click'").select(F.col("event_id").alias("observation"), F.col("user_id").alias("u"), F.col("t").alias("seen"))
    b = late.where("event_type = 'purchase'").select(F.col("event_id").alias("settlement"), "user_id", F.col("t").alias("done"), "value")
    on = (F.col("u") == F.col("user_id")) & (F.col("done") >= F.col("seen")) & (F.col("done") <= F.col("seen") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("observation", "settlement", "value")
