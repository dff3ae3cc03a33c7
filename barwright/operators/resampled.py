"""Bootstrap of a rank statistic: whole blocks are drawn again, every replicate in one pass over the ranked scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chances of a Poisson variate of mean 1 to be at most 0, 1, 2, ...
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
RANGES = 64


def weight(block: Column, draw: Column) -> Column:
    """How often a draw holds a block: a Poisson variate from the first 32 bits of their MD5 digest."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", block, draw)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def block_weights(blocks: DataFrame, block: str, draws: int) -> DataFrame:
    """(block, weights): an array of one weight a draw for each distinct block; draw 0 holds every block once."""
    each = F.transform(F.sequence(F.lit(0), F.lit(draws)), lambda r: F.when(r == 0, 1).otherwise(weight(F.col(block).cast("string"), r)))
    return blocks.select(block).distinct().select(block, each.alias("weights"))


def auc_draws(rows: DataFrame, score: str, outcome: str, block: str, draws: int) -> DataFrame:
    """(draw, auc) of ``rows`` (a score, an outcome of 0 or 1, a block): draw 0 is the statistic itself, ties count a half.

    Rows are counted per (score, block) first. In each range of scores a task goes through them in order and carries, for
    all draws at once, the weight of outcomes 0 so far; ranges are put together from three arrays each. Rows without a score, an
    outcome or a block are left out; a draw without either outcome has a null auc.
    """
    fine = rows.select(F.col(score).cast("double").alias("score"), F.col(outcome).alias("y"), F.col(block).alias("block")).dropna()
    counted = fine.groupBy("score", "block").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    cuts = counted.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("score"))) if cuts else F.lit(0)
    dealt = counted.join(block_weights(fine, "block", draws), "block").select(place.cast("int").alias("place"), "score", "p", "q", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = lambda: np.zeros(draws + 1)
        at, last, sums = None, None, [zeros() for _ in range(5)]  # up, down, won, and up and down at the open score

        def closed() -> None:
            up, down, won, here_up, here_down = sums
            won += here_up * (down + here_down / 2)
            up += here_up
            down += here_down
            sums[3], sums[4] = zeros(), zeros()

        def record() -> pa.RecordBatch:
            closed()
            return pa.record_batch([pa.array([at], pa.int32()), *[pa.array([s.tolist()]) for s in sums[:3]]], ["place", "up", "down", "won"])

        for batch in batches:
            if not batch.num_rows:
                continue
            weights = np.stack(batch.column("weights").to_numpy(zero_copy_only=False)).astype(float)
            for i, (place_, score_, p, q) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "score", "p", "q")))):
                if place_ != at:
                    if at is not None:
                        yield record()
                    at, last, sums = place_, score_, [zeros() for _ in range(5)]
                elif score_ != last:
                    closed()
                    last = score_
                sums[3] += p * weights[i]
                sums[4] += q * weights[i]
        if at is not None:
            yield record()

    arrays = ", ".join(f"{c} array<double>" for c in ("up", "down", "won"))
    parts = dealt.repartition("place").sortWithinPartitions("place", "score").mapInArrow(run, f"place int, {arrays}")
    long = parts.select("place", F.posexplode(F.arrays_zip("up", "down", "won")).alias("draw", "s")).select("place", "draw", "s.*")
    before = F.coalesce(F.sum("down").over(Window.partitionBy("draw").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row for each range
    put = long.withColumn("all_won", F.col("won") + F.col("up") * before).groupBy("draw").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("all_won").alias("won"))
    return put.select("draw", F.try_divide("won", F.col("up") * F.col("down")).alias("auc"))


def interval(draws: DataFrame, column: str, level: float = 0.9) -> Column:
    """struct(lo, hi): the percentiles of ``column`` over draws from 1 on, as an aggregate."""
    value = F.when(F.col("draw") > 0, F.col(column))
    return F.struct(F.percentile(value, (1 - level) / 2).alias("lo"), F.percentile(value, (1 + level) / 2).alias("hi"))
