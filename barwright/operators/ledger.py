"""A queue's drops against traded volume: what left the book was consumed, pulled, or is still open.

A drop and a volume account for each other, each once, if they are at most ``lag`` apart: whichever comes later takes from the
open ones of the other kind, oldest first. What is left of a drop when the lag has run out was pulled.

Where a key is quiet for longer than the lag nothing is open, so its events fall into stretches that don't depend on each other.
They, not keys, are dealt to tasks, and a task holds the open entries of one lag of one stretch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantities below this are nothing.
NOTHING = 1e-9
VOLUME = "volume"


def settle(events: DataFrame, key: str, lag: float) -> DataFrame:
    """(key, kind, id, whole, t, quantity, entry, at): what became of every drop of ``events`` (key, t, seq, kind, id, quantity).

    ``t`` is a number, ``seq`` orders events of one time, ``kind`` is 'volume' or the side of a drop, ``id`` names a drop.
    Entries: 'traded' (``at``: when the later of both came), 'pulled' (``at``: when the lag had run out) and 'open' (no event yet
    beyond the lag; ``at`` null). A drop's entries add up to its quantity. Events without a quantity above 0, a time or a
    kind are left out; a null key is a key of its own.
    """
    w = Window.partitionBy(key).orderBy("t", "seq")
    fine = events.where(f"quantity > {NOTHING} AND t IS NOT NULL AND kind IS NOT NULL")
    fine = fine.select(key, F.col("t").cast("double").alias("t"), "seq", "kind", "id", F.col("quantity").cast("double").alias("quantity"))
    quiet = (F.col("t") - F.lag("t").over(w) > lag).cast("int")
    parts = fine.withColumn("stretch", F.coalesce(F.sum(quiet).over(w), F.lit(0)).cast("long")).withColumn("last_t", F.max("t").over(Window.partitionBy(key)))
    schema = parts.select(key, "kind", "id", F.col("quantity").alias("whole"), "t", "quantity", F.lit("").alias("entry"), F.col("t").alias("at")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, opened = None, deque()

        def close(e: list) -> tuple:
            overdue = e[5] > e[2] + lag  # the key goes on beyond the lag
            return (e[3], e[4], e[0], e[6], e[2], e[1], "pulled" if overdue else "open", e[2] + lag if overdue else None)

        for batch in batches:
            out = []
            for k, t, kind, name, q, stretch, end in zip(*(batch[c] for c in (key, "t", "kind", "id", "quantity", "stretch", "last_t"))):
                if (k, stretch) != of:
                    out += [close(e) for e in opened if e[4] != VOLUME]
                    of, opened = (k, stretch), deque()
                while opened and opened[0][2] < t - lag:
                    e = opened.popleft()
                    if e[4] != VOLUME:
                        out.append(close(e))
                left = q
                while left > NOTHING and opened and (opened[0][4] == VOLUME) != (kind == VOLUME):
                    e = opened[0]
                    take = min(left, e[1])
                    left, e[1] = left - take, e[1] - take
                    out.append((k, kind, name, q, t, take, "traded", t) if e[4] == VOLUME else (k, e[4], e[0], e[6], e[2], take, "traded", t))
                    if e[1] <= NOTHING:
                        opened.popleft()
                if left > NOTHING:
                    opened.append([name, left, t, k, kind, end, q])
            yield pd.DataFrame(out, columns=[f.name for f in schema])
        yield pd.DataFrame([close(e) for e in opened if e[4] != VOLUME], columns=[f.name for f in schema])

    return parts.repartition(key, "stretch").sortWithinPartitions(key, "stretch", "t", "seq").mapInPandas(run, schema)


def drops(entries: DataFrame, key: str) -> DataFrame:
    """(key, kind, id, t, quantity, traded, pulled, open): one row for each drop of ``settle``'s entries."""
    of = lambda name: F.sum(F.when(F.col("entry") == name, F.col("quantity")).otherwise(0.0)).alias(name)
    return entries.groupBy(key, "kind", "id", "t").agg(F.first("whole").alias("whole"), of("traded"), of("pulled"), of("open")).withColumnRenamed("whole", "quantity")
