"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _mark(edges: DataFrame) -> tuple:
    """Number of rows and an order-free digest; equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Connect what ``keep`` leaves of ``pairs`` (u, v) to the smallest neighbour of its u.

    The minima are a written table, so that both sides of the join are plain shuffles and a hub's rows can be
    split over tasks.
    """
    low = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    return pairs.join(low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(links: DataFrame) -> DataFrame:
    """Table (node, root) for every node of ``links`` (u long, v long); root is the component's smallest node.

    Each round shuffles the links, never a group: minima are partial aggregates. Rounds needed grow with the
    logarithm of the longest chain. Nulls must not occur; self-links and repeated links are allowed.
    """
    edges = materialise(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        large = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        small = _star(large.unionByName(large.select("u", F.col("u").alias("v"))), F.lit(True))
        edges = materialise(small.distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
