"""Relations of bars' fields to an outcome, found by description length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import near, near_sql
from ..operators.relations import first_splits, grow_tree
from ..sources.tables import BARS, bars
from .registry import query

NUMERIC, CATEGORICAL = ["trades", "turnover", "volume"], ["weekday"]


def cases(spark, sf_dir) -> DataFrame:
    """Bars and whether their range is wide; turnover is missing where nothing above 1000 was turned over."""
    b = bars(spark, sf_dir)
    turnover = F.when(F.col("turnover") > 1000, F.floor(F.col("turnover") / 500))
    outcome = F.when(F.col("high") > 3 * F.col("low"), "wide").when(F.col("high") > F.col("low"), "narrow").otherwise("one price")
    return b.select(outcome.alias("outcome"), "trades", turnover.alias("turnover"), "volume", F.weekday("ts").cast("string").alias("weekday"))


CASES = f"""{BARS}, cases AS (
  SELECT CASE WHEN high > 3 * low THEN 'wide' WHEN high > low THEN 'narrow' ELSE 'one price' END AS outcome, trades::DOUBLE AS trades,
    CASE WHEN turnover > 1000 THEN floor(turnover / 500) END AS turnover, volume, CAST(isodow(ts) - 1 AS VARCHAR) AS weekday FROM bars)"""
BITS = "CASE WHEN n <= 1 THEN 0 ELSE 1 + log2(k) + n * log2(n) - s END"
PARTS = "sum(n) AS n, count(*) AS k, sum(n * log2(n)) AS s"


@query(f"""WITH {CASES},
long AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, {f} AS x, outcome, count(*)::DOUBLE AS n FROM cases GROUP BY ALL" for f in NUMERIC)}),
points AS (SELECT field, x, lead(x) OVER (PARTITION BY field ORDER BY x) AS next_x, count(*) OVER (PARTITION BY field) - 1 AS candidates FROM (SELECT DISTINCT field, x FROM long WHERE x IS NOT NULL)),
cuts AS (SELECT field, x, (x + next_x) / 2 AS cut, candidates FROM points WHERE next_x IS NOT NULL),
kinds AS (SELECT DISTINCT field, outcome FROM long),
run AS (
  SELECT p.field, p.x, k.outcome, sum(coalesce(l.n, 0)) OVER (PARTITION BY p.field, k.outcome ORDER BY p.x) AS n, sum(coalesce(l.n, 0)) OVER (PARTITION BY p.field, k.outcome) AS whole
  FROM points p JOIN kinds k USING (field) LEFT JOIN long l ON l.field = p.field AND l.outcome = k.outcome AND l.x = p.x),
sides AS (SELECT field, x, 'low' AS side, n FROM run WHERE n > 0 UNION ALL SELECT field, x, 'high', whole - n FROM run WHERE whole > n),
cost AS (SELECT field, x, side, {BITS} AS bits FROM (SELECT field, x, side, {PARTS} FROM sides GROUP BY ALL)),
lost AS (SELECT field, {BITS} AS bits FROM (SELECT field, {PARTS} FROM long WHERE x IS NULL GROUP BY field)),
numbers AS (
  SELECT c.field, c.cut, c.candidates, 1 + log2(4) + log2(c.candidates) + 1 + log2(CASE WHEN any_value(l.bits) IS NULL THEN 2 ELSE 3 END) + sum(o.bits) + coalesce(any_value(l.bits), 0) AS bits
  FROM cuts c JOIN cost o ON o.field = c.field AND o.x = c.x LEFT JOIN lost l ON l.field = c.field GROUP BY c.field, c.cut, c.candidates),
words AS (
  SELECT 'weekday' AS field, CAST(NULL AS DOUBLE) AS cut, 1 AS candidates, 1 + log2(4) + 1 + log2(count(*)) + sum({BITS}) AS bits
  FROM (SELECT weekday, {PARTS} FROM (SELECT weekday, outcome, count(*)::DOUBLE AS n FROM cases GROUP BY ALL) GROUP BY weekday) HAVING count(*) > 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(bits, 6), cut) AS r FROM (SELECT * FROM numbers UNION ALL SELECT * FROM words))
SELECT field, cut, candidates::BIGINT AS candidates, {near_sql('round(bits, 3)')} AS bits FROM ranked WHERE r = 1""")
def relation_splits(spark, sf_dir):
    """For each field the split of all bars that describes how wide they are in the fewest bits."""
    s = first_splits(cases(spark, sf_dir), "outcome", NUMERIC, CATEGORICAL)
    return s.select("field", "cut", "candidates", near(F.round("bits", 3)).alias("bits"))


@query()
def relation_tree(spark, sf_dir):
    """The whole tree for the same bars; its depth is the data's choice. Tests compare it with one grown case by case."""
    return grow_tree(cases(spark, sf_dir), "outcome", NUMERIC, CATEGORICAL)
