"""Exact percentiles of a few large groups, without a task or a map of all values for each of them.

Approximate percentiles a little below and above each share cut a group into ranges. Ranges are counted, and only the narrow ones
around a share are counted by value; the ranks looked for follow from sums of these counts. If a rank lies in none of the narrow ranges,
they are widened and counted again, at last to all values: the result is exact however rough the cuts are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Accuracy of the cuts, how far from a share they are at first (twice their largest error), and by how much that grows.
ACCURACY, BESIDE, WIDER = 10_000, 2e-4, 50


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, not twice: the product's and the sum's rounding errors are taken along (Dekker, Knuth)."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731  the upper half of the digits
    p, s = a * b, a * b + c
    lost = ((high(a) * high(b) - p) + high(a) * (b - high(b)) + (a - high(a)) * high(b)) + (a - high(a)) * (b - high(b))
    cut = (p - (s - (s - p))) + (c - (s - p))
    return F.when(F.greatest(F.abs(a), F.abs(b), F.abs(s)) < 1e290, s + (cut + lost)).otherwise(s)


def interpolated(lower: Column, upper: Column, part: Column) -> Column:
    """Between two neighbouring values, to the last digit as the SQL's continuous percentile has it."""
    return F.when(part == 0, lower).otherwise(fused(lower, 1 - part, upper * part))


def summed_up(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], *sums: Column) -> DataFrame:
    """(by, sums, shares): ``rows`` grouped, with these aggregates and, for each of ``shares``, the exact percentile of ``value``.

    ``rows`` are read twice at once (see ``stored``), the result not from them. There is a row for each group and a narrow range, a
    few ten-thousandths of the rows, in one task.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])
    ordered = sorted(shares.items(), key=lambda s: s[1])
    beside, groups = BESIDE, None
    while True:
        # Ranges of shares around those looked for; two that meet are one.
        spans = []
        for _, p in ordered:
            if spans and p - beside <= spans[-1][1]:
                spans[-1][1] = p + beside
            else:
                spans.append([p - beside, p + beside])
        ends = sorted({x for s in spans for x in s if 0 < x < 1})
        cuts = F.percentile_approx(value, ends, ACCURACY).alias("_cuts") if ends else F.lit(None).alias("_cuts")
        if groups is None:
            groups = checkpointed(rows.groupBy(*by).agg(*sums, F.count(value).alias("_n"), cuts))
            cut = groups
        else:
            cut = rows.groupBy(*by).agg(cuts)
        # An even place is outside of the spans, an odd one inside; ends belong to the inside.
        place = F.lit(0)
        for lower, upper in spans:
            place = place + ((F.col(value) >= F.col("_cuts")[ends.index(lower)]).cast("int") if lower > 0 else F.lit(1))
            place = place + ((F.col(value) > F.col("_cuts")[ends.index(upper)]).cast("int") if upper < 1 else F.lit(0))
        met = rows.where(F.col(value).isNotNull()).alias("r").join(F.broadcast(cut.select(*by, "_cuts")).alias("c"), same("r", "c"))  # a row for each group
        placed = met.select(*[F.col(f"r.{c}").alias(c) for c in by], F.col(f"r.{value}").alias("_v"), place.alias("_place"))
        counts = checkpointed(placed.groupBy(*by, "_place", F.when(F.col("_place") % 2 == 1, F.col("_v")).alias("_v")).agg(F.count("*").alias("_k")))
        totals = counts.groupBy(*by, "_place").agg(F.sum("_k").alias("_k"))
        before = totals.select(*by, "_place", F.coalesce(F.sum("_k").over(Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        inside = Window.partitionBy(*by, "_place").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        run = counts.where("_place % 2 = 1").withColumn("_upto", F.sum("_k").over(inside)).alias("x").join(before.alias("b"), same("x", "b") & F.expr("x._place = b._place"))
        ends_at = run.select(*[F.col(f"x.{c}").alias(c) for c in by], "_v", (F.col("_upto") + F.col("_before")).alias("_upto"), (F.col("_upto") + F.col("_before") - F.col("_k")).alias("_from")).alias("e")
        at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in ordered}
        of = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("_v")))
        found = checkpointed(ends_at.join(F.broadcast(groups.select(*by, "_n")).alias("g"), same("e", "g")).groupBy(*[F.col(f"e.{c}").alias(c) for c in by]).agg(*[
            of(edge(at[name])).alias(f"_{kind}_{name}") for name in shares for kind, edge in (("lower", F.floor), ("upper", F.ceil))
        ]))
        got = groups.alias("g").join(found.alias("f"), same("g", "f"), "left")
        missed = got.where(F.col("_n") > 0).where(reduce(lambda x, y: x | y, [F.col(f"_{k}_{n}").isNull() for n in shares for k in ("lower", "upper")]))
        if not ends or missed.isEmpty():
            break
        beside *= WIDER
    part = lambda name: at[name] - F.floor(at[name])
    kept = [c for c in groups.columns if c not in (*by, "_n", "_cuts")]
    return got.select(*[F.col(f"g.{c}").alias(c) for c in by], *kept, *[interpolated(F.col(f"_lower_{n}"), F.col(f"_upper_{n}"), part(n)).alias(n) for n in shares])
