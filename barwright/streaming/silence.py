"""Silences of a stream's keys, reported by event-time timers though no further event comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State with timers needs a store that can hold many kinds of it.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Silence(StatefulProcessor):
    """Reports (symbol, since, until) in milliseconds for each two neighbouring events of a key more than ``limit`` apart.

    Events wait until the watermark has passed them, so those that come out of order are compared in order; only times not
    yet passed are kept, and the last that was. A key whose last event is more than ``limit`` behind the watermark is reported once
    with a null ``until``, and again with its end if one comes.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long")
        self.last = handle.getValueState("last", "t long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList([(int(t),) for t in batch["t_ms"].unique()])
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs())

    def settle(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        times = sorted({r[0] for r in self.waiting.get()})
        passed = [t for t in times if t <= watermark]
        last, told = self.last.get() if self.last.exists() else (None, False)
        found = []
        for t in passed:
            if last is not None and t - last > self.limit:
                found.append((last, t))
            if last is None or t > last:
                last, told = t, False
        if last is not None and not told and watermark > last + self.limit:
            found.append((last, None))
            told = True
        if last is not None:
            self.last.update((last, told))
        if passed and len(passed) < len(times):
            self.waiting.put([(t,) for t in times[len(passed) :]])
        elif passed:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Wake up when the next waiting event is passed, or when the last one has been silent for too long.
        wakes = [times[len(passed)]] if len(passed) < len(times) else []
        wakes += [last + self.limit + 1] if last is not None and not told else []
        if wakes:
            self.handle.registerTimer(max(min(wakes), watermark + 1))
        if found:
            yield pd.DataFrame({"symbol": key[0], "since": [s for s, _ in found], "until": pd.array([u for _, u in found], "Int64")})

    def close(self) -> None:
        pass


def silences(events: DataFrame, key: str, limit: int, late: str) -> DataFrame:
    """(symbol, since, until) of a stream with event times ``t``; ``limit`` in milliseconds, ``late`` how far events may be out of order.

    Sets the session's state store to one that keeps timers. Rows with a null key or time are left out.
    """
    spark = events.sparkSession
    spark.conf.set(STORE, ROCKS)
    rows = events.withWatermark("t", late).where(F.col(key).isNotNull() & F.col("t").isNotNull()).select(F.col(key).cast("long").alias("symbol"), "t", F.unix_millis("t").alias("t_ms"))
    return rows.groupBy("symbol").transformWithStateInPandas(Silence(limit), "symbol long, since long, until long", "Append", "EventTime")
