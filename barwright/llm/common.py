"""What the operators share: the folder all executors see, cut lineage, safe column names, exact global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract: U+0020 and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests on one machine), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a recomputation, and what follows may use the
    rows more than once at the price of a scan.
    """
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """``df``'s own column of that very name, also where a name holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def n_words(text: Column) -> Column:
    """Number of words in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(df: DataFrame, order: list[Column], value: str, total: str) -> DataFrame:
    """``df`` in the global order ``order`` with a column ``total``: the sum of ``value`` over all rows before it.

    Rows are range-partitioned and sorted, written once, and each partition's sum (one number per partition) goes
    to the driver; no partition holds more than its range. ``order`` has to tell rows apart for the result to
    be the same in each run. ``value`` must not be null. Adds the column ``total`` as long.
    """
    spark = df.sparkSession
    part = free_name(df, "part_")
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    kept = materialise(spread, "ordered")
    sums = {r[0]: r[1] for r in kept.groupBy(part).agg(F.sum(value)).collect()}
    before, at = {}, 0
    for p in sorted(sums):
        before[p], at = at, at + sums[p]
    names = [c for c in kept.columns if c != part]

    from pyspark.sql import Window

    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.createDataFrame(sorted(before.items()), f"{part} int, offset_ long")
    offset = free_name(kept, "offset_")
    offsets = offsets.withColumnRenamed("offset_", offset)
    return (
        kept.join(F.broadcast(offsets), part)
        .withColumn(total, (F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col(offset)).cast("long"))
        .select(*[column(kept, c) for c in names], F.col(total))
    )


def batches_by_run(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Arrow batches of a partition sorted by ``key`` as tables that hold whole runs of equal keys.

    Only the last, still open run is carried into the next batch.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            if cut == 0:
                yield pa.Table.from_batches(held)
                held = [batch]
                continue
        if cut == 0:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def partition_id() -> int:
    return TaskContext.get().partitionId()
