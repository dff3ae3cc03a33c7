"""How long a quantity has stood at a share of what it is now."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_since(obs: DataFrame, keys: list[str], time: str, quantity: str, share: float = 0.5) -> DataFrame:
    """Adds ``since``: from when on the key's quantity has never been below ``share`` of the row's own (a number, as ``time`` is).

    The last smaller element, with a moving bound. A task goes through its keys' rows in order of time and holds a
    staircase of one key: ends of the past by their smallest quantity, which is found in by bisection and only grows while quantities do.
    A row's own time counts, so ``since`` is at most that. Rows without a time or a quantity are left out; of equal times the
    smaller quantity comes first.
    """
    fine = obs.where(F.col(time).isNotNull() & F.col(quantity).isNotNull())
    schema = fine.withColumn("since", F.col(time).cast("double")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, starts, least = None, [], []
        for batch in batches:
            since = []
            for key, t, q in zip(zip(*(batch[k] for k in keys)), batch[time], batch[quantity]):
                if key != of:
                    of, starts, least = key, [], []
                start = t
                while least and least[-1] >= q:
                    start = starts.pop()
                    least.pop()
                starts.append(start)
                least.append(q)
                since.append(float(starts[bisect_left(least, share * q)]))
            yield batch.assign(since=since)

    return fine.repartition(*keys).sortWithinPartitions(*keys, time, quantity).mapInPandas(run, schema)
