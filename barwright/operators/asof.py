"""As-of joins as one union and one window: no range join, no loop over keys.

Left and right rows of a key are dealt into time buckets and merged in time order there; the last (or next) right row is
carried over the left ones. A bucket also holds the last right row of the buckets before it, which one row for each key
and bucket is enough to find, so a key with very many rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the time buckets in seconds.
BUCKET = 30 * 86_400


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, fields: list[str], direction: str = "backward", strict: bool = False, prefix: str = "r_", bucket: int = BUCKET
) -> DataFrame:
    """Adds to each left row the ``fields`` (and ``time``) of the right row at or before (after) its time.

    ``strict`` excludes equal times. Right rows must be unique by (keys, time). Without a match the fields are null, as they
    are for a null time. Names: ``prefix`` and field. Left rows stay, repeated ones too.
    """
    lefts, at, backward = left.columns, [*fields, time], direction == "backward"
    value = F.struct(*[F.col(c) for c in at])
    number = F.floor(seconds(F.col(time)) / bucket)
    kind = right.select(value.alias("v")).schema["v"].dataType
    a = left.select(*keys, number.alias("_b"), F.col(time).alias("_t"), F.struct(*lefts).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    own = right.where(F.col(time).isNotNull()).select(*keys, number.alias("_b"), F.col(time).alias("_t"), value.alias("_right"))
    b = own.select(*keys, "_b", "_t", F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_right")
    # Each bucket's last (first) right row, carried to the buckets behind (before) it: a row for each key and bucket.
    edge = (F.max_by if backward else F.min_by)("_right", "_t").alias("_edge")
    edges = own.groupBy(*keys, "_b").agg(edge).unionByName(a.where("_b IS NOT NULL").select(*keys, "_b").distinct(), allowMissingColumns=True)
    edges = edges.groupBy(*keys, "_b").agg(F.first("_edge", True).alias("_edge"))
    buckets = Window.partitionBy(*keys).orderBy(F.col("_b") if backward else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("_right", F.last("_edge", True).over(buckets)).where("_right IS NOT NULL")
    carried = carried.select(*keys, "_b", F.lit(None).cast(a.schema["_t"].dataType).alias("_t"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_right")
    # At equal times right rows stand before left ones, or after them if equal times must not match.
    right_first = backward != strict
    side = F.when(F.col("_right").isNotNull(), 0 if right_first else 1).otherwise(1 if right_first else 0)
    order = F.col("_t").asc_nulls_first() if backward else F.col("_t").asc_nulls_last()
    w = Window.partitionBy(*keys, "_b").orderBy(order, side)
    seen = F.last("_right", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if backward else F.first("_right", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = a.unionByName(b).unionByName(carried).withColumn("_m", seen).where("_left IS NOT NULL")
    return out.select(*[F.col("_left")[c].alias(c) for c in lefts], *[F.col("_m")[c].alias(prefix + c) for c in at])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, fields: list[str], tolerance: float) -> DataFrame:
    """The right row nearest in time within ``tolerance`` seconds, of equally near ones the earlier; ``dt`` is right minus left."""
    back = asof(left, right, keys, time, fields, "backward", prefix="b_")
    both = asof(back, right, keys, time, fields, "forward", prefix="f_")
    db, df = seconds(F.col(f"b_{time}")) - seconds(F.col(time)), seconds(F.col(f"f_{time}")) - seconds(F.col(time))
    take_back = df.isNull() | (-db <= df)
    dt = F.when(take_back, db).otherwise(df)
    near = F.abs(dt) <= tolerance
    cols = [F.when(near, F.when(take_back, F.col(f"b_{c}")).otherwise(F.col(f"f_{c}"))).alias(f"r_{c}") for c in [*fields, time]]
    return both.select(*left.columns, *cols, F.when(near, dt).alias("dt"))


def seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1e6
