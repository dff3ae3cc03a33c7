"""Shocks of a book's depth and how it comes back: one record for each, sampled at fixed delays and fitted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequential import cooldown


@dataclass(frozen=True)
class Rules:
    """Times in the unit of ``time``: a fall within ``burst``, against the median of the rest of ``base``; a curve ends after ``timeout``.

    Shares of that median: a fall of ``drop`` to below ``back`` is a shock, and from ``back`` on it has recovered; above
    ``over`` it overshoots. Less than ``points`` observations make no median.
    """

    burst: float = 30
    base: float = 300
    timeout: float = 600
    drop: float = 0.5
    back: float = 0.9
    over: float = 1.3
    points: int = 3


def shocks(obs: DataFrame, key: str, time: str, depth: str, rules: Rules) -> DataFrame:
    """(key, t, median, before, depth): observations at which depth has fallen, overlapping ones too."""
    t = Window.partitionBy(key).orderBy("t")
    rows = obs.select(key, F.col(time).cast("double").alias("t"), F.col(depth).cast("double").alias("depth")).where("t IS NOT NULL AND depth IS NOT NULL")
    past = t.rangeBetween(-rules.base, -rules.burst)
    before = F.last("depth").over(t.rangeBetween(Window.unboundedPreceding, -rules.burst))
    seen = rows.select(key, "t", "depth", F.percentile("depth", 0.5).over(past).alias("median"), F.count("*").over(past).alias("n"), before.alias("before"))
    fallen = (F.col("before") - F.col("depth") >= rules.drop * F.col("median")) & (F.col("depth") < rules.back * F.col("median"))
    return seen.where((F.col("n") >= rules.points) & (F.col("median") > 0) & fallen).select(key, "t", "median", "before", "depth")


def curves(obs: DataFrame, found: DataFrame, key: str, time: str, depth: str, rules: Rules, delays: list[float]) -> DataFrame:
    """(key, t, median, points, share_at_shock, share_last, share_at_<delay>..., recovered_after, ended, overshoot, tau, fit_r2) per shock.

    Shares are of the median before. A curve is the observations up to the first with a share of ``rules.back`` or the time-out; at a
    delay it has the last share seen by then. ``tau`` is the time constant of the deficit, from the line through its logarithms (three
    at least), null where the deficit doesn't shrink. Shocks and observations meet in buckets of ``rules.timeout``, of which a
    curve touches two, and all of a curve is one aggregate; overlapping shocks have each their own.
    """
    rows = obs.select(key, F.col(time).cast("double").alias("u"), F.col(depth).cast("double").alias("d")).where("u IS NOT NULL AND d IS NOT NULL")
    bucket = lambda c: F.floor(F.col(c) / rules.timeout)
    touched = found.withColumn("bucket", F.explode(F.array(bucket("t"), bucket("t") + 1)))
    met = touched.join(rows.withColumn("bucket", bucket("u")), [key, "bucket"]).where(f"u >= t AND u <= t + {rules.timeout}")
    shared = met.select(key, "t", "median", (F.col("u") - F.col("t")).alias("s"), (F.col("d") / F.col("median")).alias("share"))
    recovered = F.min(F.when((F.col("share") >= rules.back) & (F.col("s") > 0), F.col("s"))).over(Window.partitionBy(key, "t"))
    curve = shared.withColumn("recovered_after", recovered).where("recovered_after IS NULL OR s <= recovered_after")
    log = F.when(F.col("share") < 1, F.ln(1 - F.col("share")))
    on = F.when(log.isNotNull(), F.col("s"))
    at = [F.max_by("share", F.when(F.col("s") <= d, F.col("s"))).alias(f"share_at_{d:g}") for d in delays]
    out = curve.groupBy(key, "t", "median", "recovered_after").agg(
        F.count("*").alias("points"), F.min_by("share", "s").alias("share_at_shock"), F.max_by("share", "s").alias("share_last"), *at, F.max("share").alias("most"),
        F.count(log).alias("fitted"), F.regr_slope(log, on).alias("slope"), F.regr_r2(log, on).alias("r2"),
    )
    shrinks = (F.col("fitted") >= 3) & (F.col("slope") < -1e-12)
    return out.select(
        key, "t", "median", "points", "share_at_shock", "share_last", *[F.col(f"share_at_{d:g}") for d in delays], "recovered_after",
        (F.col("t") + F.coalesce("recovered_after", F.lit(float(rules.timeout)))).alias("ended"), (F.col("most") > rules.over).alias("overshoot"),
        F.when(shrinks, -1 / F.col("slope")).alias("tau"), F.when(shrinks, F.col("r2")).alias("fit_r2"),
    )


def tracked(curves_: DataFrame, key: str) -> DataFrame:
    """The curves of which none starts while another of its key is open: the first, and from then on the first after each one's end."""
    return cooldown(curves_.withColumn("length", F.col("ended") - F.col("t")), key, "t", "length").drop("length")
