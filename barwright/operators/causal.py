"""How a value stands among the earlier ones of its key; large keys are no single task.

A row's earlier and smaller rows are those of earlier time ranges and lower value ranges (sums over a small grid), those of earlier
time ranges in its own value range, and those of its own time range. The last two are counted within one range of a key at a
time, by merging.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time and of values; a large key's rows in one of them are a task's.
RANGES = 64
#: Rows of a key that a task may hold.
WHOLE = 1_000_000


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value the number of smaller ones before it, by merging blocks of doubling length."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    out, at, width = np.zeros(n, np.int64), np.arange(n), 1
    while width < n:
        pair, right = at // (2 * width), at // width % 2 == 1
        lefts = np.sort(pair[~right] * n + rank[~right])
        mine = pair[right] * n
        out[right] += np.searchsorted(lefts, mine + rank[right]) - np.searchsorted(lefts, mine)
        width *= 2
    return out


def _place(df: DataFrame, column: str) -> Column:
    cuts = sorted(set(df.agg(F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []))
    return (F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(column))) if cuts else F.lit(0)).cast("int")


def _whole(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``earlier_below`` in one pass over keys in order, many keys at a time."""
    past = rows.withColumn("earlier", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
    schema = past.withColumn("below", F.col("earlier")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the beginning of a key that the next batch may go on with

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(table.column("earlier").to_numpy() == 0)
            rank = np.unique(table.column(value).to_numpy(), return_inverse=True)[1].astype(np.int64)
            # Rows of keys before are larger than all of this one.
            below = smaller_before((group[-1] - group) * table.num_rows + rank)
            yield from table.append_column("below", pa.array(below)).select(schema.names).to_batches()

        for batch in batches:
            starts = np.flatnonzero(batch.column("earlier").to_numpy() == 0)
            if len(starts):
                whole = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
                if whole.num_rows:
                    yield from done(whole)
                held = []
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from done(pa.Table.from_batches(held))

    return past.mapInArrow(run, schema)  # as the window leaves them: all rows of a key in one task, in order


def earlier_below(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``earlier``, the number of rows of the key with a smaller ``order``, and ``below``, those of them with a smaller ``value``.

    ``order`` (a number) must be unique within the key; rows without an order or a value are left out. Keys of up to WHOLE rows are
    counted whole, in one pass; larger ones are dealt out in ranges.
    """
    fine = df.where(F.col(order).isNotNull() & F.col(value).isNotNull())
    large = [r[0] for r in fine.groupBy(key).count().where(F.col("count") > WHOLE).select(key).collect()]
    if not large:
        return _whole(fine, key, order, value)
    apart = F.col(key).isin([k for k in large if k is not None])
    apart = F.coalesce(apart, F.lit(False)) | (F.col(key).isNull() & F.lit(None in large))
    return _whole(fine.where(~apart), key, order, value).unionByName(_in_ranges(fine.where(apart), key, order, value))


def _in_ranges(fine: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``earlier_below`` of large keys, a null one too."""
    given, key, fine = fine.columns, "_key", fine.withColumn("_key", F.to_json(F.struct(key)))
    rows = fine.withColumns({"_t": _place(fine, order), "_v": _place(fine, value)})
    longs = rows.withColumns({"earlier": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})

    def own_time(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(order, "ascending")]))
        below = smaller_before(group.column(value).to_numpy())
        return group.append_column("earlier", pa.array(np.arange(group.num_rows))).append_column("below", pa.array(below))

    def own_values(group: pa.Table) -> pa.Table:
        # In order of time ranges, and within one from large to small, so that none of its own range is both before and smaller.
        group = group.take(pc.sort_indices(group, [("_t", "ascending"), (value, "descending")]))
        more = smaller_before(group.column(value).to_numpy())
        at = group.schema.get_field_index("below")
        return group.set_column(at, "below", pc.add(group.column("below"), pa.array(more)))

    timed = rows.groupBy(key, "_t").applyInArrow(own_time, longs.schema)
    local = timed.groupBy(key, "_v").applyInArrow(own_values, longs.schema)
    cells = rows.groupBy(key, "_t", "_v").agg(F.count("*").alias("n"))
    # Of each value range the rows of lower ones by time range, as one array: a few rows a key.
    lower = Window.partitionBy(key).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    by_time = cells.groupBy(key, "_v").agg(*[F.sum(F.when(F.col("_t") == i, F.col("n")).otherwise(0)).alias(f"_{i}") for i in range(RANGES)])
    under = by_time.select(key, "_v", F.array(*[F.coalesce(F.sum(f"_{i}").over(lower), F.lit(0)) for i in range(RANGES)]).alias("under"))
    sums = cells.join(under, [key, "_v"]).select(key, "_t", "_v", F.aggregate(F.slice("under", 1, F.col("_t")), F.lit(0).cast("long"), lambda s, x: s + x).alias("_below"))
    past = Window.partitionBy(key).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy(key, "_t").agg(F.sum("n").alias("n")).select(key, "_t", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_earlier"))
    found = local.join(sums, [key, "_t", "_v"]).join(before, [key, "_t"])
    return found.select(*given, (F.col("earlier") + F.col("_earlier")).alias("earlier"), (F.col("below") + F.col("_below")).alias("below"))
