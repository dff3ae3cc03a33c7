"""Intervals of rank statistics from draws of whole blocks, differences on the same draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.windows import near, near_sql
from ..operators.resampled import POISSON, auc_draws, interval
from ..sources.tables import table
from .registry import query

DRAWS = 60
#: Scores of labelled documents: their length, their lines and, as an ablation of the two together, their length without lines.
SCORES = {"length": "n_chars", "lines": "len(string_split(text, chr(10)))", "joint": "n_chars + 100 * len(string_split(text, chr(10)))"}
WEIGHT = " + ".join(f"(u >= {p})::INT" for p in POISSON)
AUCS = f"""x AS (SELECT source AS block, quality AS y, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in SCORES.items())} FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND text IS NOT NULL AND quality IS NOT NULL),
u AS (SELECT block, draw, ('0x' || substr(md5(block || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT block FROM x), range({DRAWS + 1}) r(draw)),
w AS (SELECT block, draw, CASE WHEN draw = 0 THEN 1 ELSE {WEIGHT} END AS w FROM u),
s AS ({' UNION ALL '.join(f"SELECT '{n}' AS score, draw, {n} AS v, sum(w * (y = 1)::INT)::DOUBLE AS p, sum(w * (y = 0)::INT)::DOUBLE AS q FROM x JOIN w USING (block) GROUP BY draw, {n}" for n in SCORES)}),
r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY score, draw ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
a AS (SELECT score, draw, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc FROM r GROUP BY ALL)"""


def bounds(x: str) -> str:
    return f"{near_sql(f'max({x}) FILTER (draw = 0)')} AS {{0}}, {near_sql(f'quantile_cont({x}, 0.05) FILTER (draw > 0)')} AS {{0}}_lo, {near_sql(f'quantile_cont({x}, 0.95) FILTER (draw > 0)')} AS {{0}}_hi"


@query(f"""WITH {AUCS}, d AS (SELECT draw, max(auc) FILTER (score = 'length') AS length, max(auc) FILTER (score = 'lines') AS lines, max(auc) FILTER (score = 'joint') AS joint FROM a GROUP BY draw)
SELECT {bounds('length').format('length_auc')}, {bounds('length - lines').format('difference')}, {bounds('joint - length').format('added_by_lines')} FROM d""")
def auc_intervals(spark, sf_dir):
    """Ninety percent intervals over draws of whole sources: of an AUC, of the difference of two on the same draws, and of an ablation."""
    lines = F.size(F.split("text", "\n", -1))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.col("n_chars").alias("length"), lines.alias("lines"), (F.col("n_chars") + 100 * lines).alias("joint"))
    x = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    each = [auc_draws(x, name, "quality", "source", DRAWS).withColumnRenamed("auc", name) for name in SCORES]
    d = reduce(lambda a, b: a.join(b, "draw"), each).selectExpr("draw", "length AS length_auc", "length - lines AS difference", "joint - length AS added_by_lines")
    names = ["length_auc", "difference", "added_by_lines"]
    one = d.agg(*[F.max(F.when(F.col("draw") == 0, F.col(n))).alias(n) for n in names], *[interval(d, n).alias(f"{n}_at") for n in names])
    return one.select(*[c for n in names for c in (near(n).alias(n), near(F.col(f"{n}_at.lo")).alias(f"{n}_lo"), near(F.col(f"{n}_at.hi")).alias(f"{n}_hi"))])
