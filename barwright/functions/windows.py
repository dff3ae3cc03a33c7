"""Window expressions with the conventions of the features: trailing windows end before the row and need a minimum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Scale of the median absolute deviation that matches a normal's standard deviation; smallest scale relative to the median.
MAD_SCALE, SCALE_FLOOR = 1.4826, 0.05


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def trailing(n: int) -> WindowSpec:
    """The n rows before the current one."""
    return by_symbol().rowsBetween(-n, -1)


def minimum(n: int) -> int:
    """Observations a trailing window of n rows needs."""
    return max(10, n // 4)


def guarded(value: Column, x: Column, w: WindowSpec, least: int) -> Column:
    """``value`` where the window holds ``least`` non-null x."""
    return F.when(F.count(x).over(w) >= least, value)


def robust_z(x: Column, n: int) -> Column:
    """(x - median) / max(scaled MAD, floor of |median|) against the trailing window; null without a scale."""
    w = trailing(n)
    past = F.collect_list(x).over(w)
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    bound = F.transform(
        F.array(F.sort_array(past)),
        lambda a: F.transform(F.array(middle(a)), lambda m: F.struct(x.alias("x"), m.alias("m"), middle(F.sort_array(F.transform(a, lambda v: F.abs(v - m)))).alias("mad")))[0],
    )
    # As the one element of an array, so that median and deviation are computed once for all their uses.
    z = F.transform(bound, lambda b: F.try_divide(b["x"] - b["m"], F.nullif(F.greatest(F.lit(MAD_SCALE) * b["mad"], F.lit(SCALE_FLOOR) * F.abs(b["m"])), F.lit(0.0))))[0]
    return F.when(F.size(past) >= minimum(n), z)


def pct_rank(x: Column, w: WindowSpec, group: list[str]) -> Column:
    """Average-tie rank over the count of non-null values."""
    ties = F.count(x).over(Window.partitionBy(*group, x))
    n = F.count(x).over(Window.partitionBy(*group))
    return F.when(x.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / n)


def run_length(condition: Column, name: str, df):
    """Adds ``name``: consecutive rows up to this one on which the condition holds."""
    b = F.coalesce(condition, F.lit(False))
    island = F.sum((~b).cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_b", b).withColumn("_island", island).withColumn(
        name, F.sum(F.col("_b").cast("int")).over(Window.partitionBy("symbol", "_island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_b", "_island")


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def near(x: Column | str) -> Column:
    """Six digits by scaling and floor, which engines compute alike also where a seventh digit is 5."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5) / 1e6


def near_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def sums_before(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, buckets: int = 64, place: Column | None = None) -> DataFrame:
    """Adds for each ``{name: column}`` the sum of the column over all rows with a smaller ``order``, within ``by``.

    ``order`` must be unique within ``by``. Rows are dealt into ranges at approximate percentiles (``buckets`` numbers on
    the driver), or by ``place`` if that is given, a number that only grows with ``order``; running sums stay inside a range,
    and only a row for each range carries totals on. No range holds all rows.
    """
    by = by or []
    if place is None:
        cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
        place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_range", place)
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    upto = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(starts, [*by, "_range"])
    return found.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()}).drop("_range", *[f"_{n}" for n in sums])
