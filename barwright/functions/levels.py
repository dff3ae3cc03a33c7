"""Order-book level arrays as higher-order expressions; a level is struct<price, qty>, best first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(levels: Column, value=lambda x: x["qty"]) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + value(x))


def depth(levels: Column, n: int) -> Column:
    return total(F.slice(levels, 1, n))


def best(levels: Column, field: str) -> Column:
    return F.get(levels, F.lit(0))[field]


def imbalance(b: Column, a: Column) -> Column:
    return F.try_divide(b - a, b + a)


def herfindahl(levels: Column) -> Column:
    return F.try_divide(total(levels, lambda x: x["qty"] * x["qty"]), total(levels) * total(levels))


def centroid(levels: Column, mid: Column) -> Column:
    """Quantity-weighted distance from the mid."""
    return F.try_divide(total(levels, lambda x: x["qty"] * F.abs(x["price"] - mid)), total(levels))


def wall(levels: Column) -> Column:
    return F.array_max(F.transform(levels, lambda x: x["qty"]))


def decayed(levels: Column, mid: Column, decay: float) -> Column:
    """Quantities weighted down exponentially with their relative distance from the mid."""
    return total(levels, lambda x: x["qty"] * F.exp(-F.lit(decay) * F.abs(x["price"] - mid) / mid))


def walk(levels: Column, shares: float) -> Column:
    """struct(filled, cost) of taking ``shares`` from the best level on."""
    start = F.struct(F.lit(float(shares)).alias("left"), F.lit(0.0).alias("cost"))

    def take(acc: Column, x: Column) -> Column:
        q = F.least(acc["left"], x["qty"])
        return F.struct((acc["left"] - q).alias("left"), (acc["cost"] + q * x["price"]).alias("cost"))

    return F.aggregate(levels, start, take, lambda a: F.struct((F.lit(float(shares)) - a["left"]).alias("filled"), a["cost"].alias("cost")))


def difference(before: Column, after: Column) -> Column:
    """Per price what changed: array<struct<price, change, kind>>; kinds ADD, REMOVE, INCREASE, REDUCE."""
    was, now = (F.map_from_entries(x) for x in (before, after))
    merged = F.map_entries(F.map_zip_with(was, now, lambda k, a, b: F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))))
    kind = lambda e: (
        F.when(F.element_at(was, e["key"]).isNull(), "ADD").when(F.element_at(now, e["key"]).isNull(), "REMOVE").when(e["value"] > 0, "INCREASE").otherwise("REDUCE")
    )
    return F.transform(F.filter(merged, lambda e: e["value"] != 0), lambda e: F.struct(e["key"].alias("price"), e["value"].alias("change"), kind(e).alias("kind")))
