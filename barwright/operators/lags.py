"""Correlations of one path with another some steps before, over the steps that both were observed in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Leaders whose changes are sent to all tasks.
FEW = 200


def on_grid(paths: DataFrame, key: str, bin_: str, order: str, value: str, max_gap: int) -> DataFrame:
    """(key, bin, v): the last value of each bin, carried on over at most ``max_gap`` bins without one; bins beyond are left out.

    ``bin_`` numbers steps of time, ``order`` is the time within. Nulls are no observations.
    """
    seen = paths.where(F.col(value).isNotNull() & F.col(bin_).isNotNull()).groupBy(key, F.col(bin_).cast("long").alias("bin")).agg(F.max_by(value, order).alias("v"))
    after = F.lead("bin").over(Window.partitionBy(key).orderBy("bin"))
    until = F.least(F.coalesce(after - 1, F.col("bin") + max_gap), F.col("bin") + max_gap)
    return seen.withColumn("_until", until).select(key, F.explode(F.sequence("bin", "_until")).alias("bin"), "v")


def steps(grid: DataFrame, key: str) -> DataFrame:
    """(key, bin, r): changes between neighbouring bins that both have a value."""
    w = Window.partitionBy(key).orderBy("bin")
    return grid.select(key, "bin", (F.col("v") - F.lag("v").over(w)).alias("r"), (F.col("bin") - F.lag("bin").over(w)).alias("d")).where("d = 1").drop("d")


def lagged_correlations(changes: DataFrame, pairs: DataFrame, key: str, lags: list[int]) -> DataFrame:
    """(leader, follower, lag, n, rho): the follower's changes against the leader's ``lag`` bins before, for all pairs and lags in one aggregate.

    ``pairs`` (leader, follower) bounds the work: a follower's row is met by its own leaders' rows of the same bin alone, so the join
    is as large as changes times leaders times lags. Only bins where both have a change count; rho is null for a constant side.

    Up to FEW leaders' changes are sent to all tasks: followers' rows then stay where they are and are added up there, and what is
    shuffled is a row for each pair and lag. More leaders are met in a shuffle of all rows.
    """
    pairs = checkpointed(pairs)
    leaders = [r.leader for r in pairs.select("leader").distinct().limit(FEW + 1).collect()]
    few = len(leaders) <= FEW
    led = changes.where(F.col(key).isin(leaders)) if few else changes
    lagged = led.select(F.col(key).alias("leader"), F.col("r").alias("x"), "bin", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("bin", F.col("bin") + F.col("lag"))
    ahead = lagged.groupBy("leader", "bin").agg(F.collect_list(F.struct("lag", "x")).alias("xs"))
    behind = changes.select(F.col(key).alias("follower"), "bin", F.col("r").alias("y")).join(pairs, "follower")
    met = behind.join(F.broadcast(ahead) if few else ahead, ["leader", "bin"]).select("leader", "follower", "y", F.inline("xs"))
    rho = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return met.groupBy("leader", "follower", "lag").agg(F.count("*").alias("n"), rho.alias("rho"))


def best_lag(found: DataFrame, least: int, digits: int = 6) -> DataFrame:
    """(leader, follower, lag, n, rho): of the lags with ``least`` bins the one of the highest correlation, of equal ones the smallest."""
    fit = found.where((F.col("n") >= least) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    best = F.min(F.struct((-F.round("rho", digits)).alias("o"), "lag", "n", "rho")).alias("b")
    return fit.groupBy("leader", "follower").agg(best).select("leader", "follower", "b.lag", "b.n", "b.rho")
