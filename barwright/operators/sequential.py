"""Rules in which a row depends on which rows before it were kept: per key, on executors, in time order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame


def cooldown(df: DataFrame, key: str, time: str, gap: float | str) -> DataFrame:
    """Rows at least ``gap`` after the last *kept* row of their key; the first one is kept. ``time`` is a number.

    ``gap`` is a number, or the column that has the kept row's own.

    One pass over a key's sorted rows that holds a single number, in batches, whatever the key's size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, held_key, until = True, None, 0.0
        for batch in batches:
            keep = []
            for k, t, g in zip(batch[key], batch[time], batch[gap] if isinstance(gap, str) else repeat(gap)):
                fresh = first or k != held_key or t >= until
                keep.append(fresh)
                if fresh:
                    first, held_key, until = False, k, t + g
            yield batch[keep]

    return df.repartition(key).sortWithinPartitions(key, time).mapInPandas(run, df.schema)
