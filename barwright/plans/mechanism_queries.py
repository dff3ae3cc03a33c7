"""Mechanism scores, their lifecycle and a timeline over the event tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import near_sql
from ..operators.mechanisms import ACTIVE, CONFIRM, MECHANISMS, RELEASE, features_sql, lifecycle, scores
from ..sources.tables import TAPE, tape
from .registry import query

PRINTS = f"{TAPE}, prints AS (SELECT symbol, event_id, CAST(floor(epoch_us(t) / 1000000) AS BIGINT) AS sec, value, k, CASE WHEN source IN ('click', 'purchase') THEN 1 ELSE -1 END AS side FROM tape), f AS (SELECT *, {', '.join(features_sql())} FROM prints)"
LONG = ", long AS (" + " UNION ALL ".join(f"SELECT symbol, event_id, sec, '{n}' AS mechanism, {near_sql(MECHANISMS[n])} AS score FROM f" for n in MECHANISMS) + ")"
LIFE = f"""{LONG}, m AS (SELECT *, coalesce(last_value(CASE WHEN score >= {ACTIVE} THEN true WHEN score < {RELEASE} THEN false END IGNORE NULLS) OVER w, false) AS is_on FROM long WINDOW w AS (PARTITION BY mechanism, symbol ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, is_on AND NOT coalesce(lag(is_on) OVER (PARTITION BY mechanism, symbol ORDER BY sec, event_id), false) AS starts FROM m),
g AS (SELECT *, last_value(CASE WHEN starts THEN sec END IGNORE NULLS) OVER (PARTITION BY mechanism, symbol ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS since FROM b),
life AS (SELECT symbol, event_id, sec, mechanism, score, CASE WHEN is_on AND sec - since >= {CONFIRM} THEN 'CONFIRMED' WHEN is_on THEN 'ACTIVE' WHEN score >= 0.35 THEN 'BUILDING' ELSE 'NONE' END AS phase, CASE WHEN is_on THEN sec - since END AS age FROM g)"""


def prints(spark, sf_dir):
    side = F.when(F.col("source").isin("click", "purchase"), 1).otherwise(-1)
    return tape(spark, sf_dir).select("symbol", "event_id", F.unix_seconds(F.col("t").cast("timestamp")).alias("sec"), "value", "k", side.alias("side"))


@query(f"WITH {PRINTS} SELECT symbol, event_id, " + ", ".join(f"{near_sql(e)} AS {n}" for n, e in MECHANISMS.items()) + " FROM f")
def mechanism_scores(spark, sf_dir):
    return scores(prints(spark, sf_dir)).drop("sec")


@query(f"WITH {PRINTS}{LIFE} SELECT symbol, event_id, mechanism, score, phase, age FROM life")
def mechanism_lifecycle(spark, sf_dir):
    return lifecycle(scores(prints(spark, sf_dir)), list(MECHANISMS))


@query(f"WITH {PRINTS}{LIFE} SELECT mechanism, phase, count(*) AS n, count(DISTINCT symbol) AS symbols, round(avg(score), 5) AS mean_score FROM life GROUP BY ALL")
def mechanism_timeline(spark, sf_dir):
    return mechanism_lifecycle(spark, sf_dir).groupBy("mechanism", "phase").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.round(F.avg("score"), 5).alias("mean_score"))


@query(f"WITH {PRINTS} SELECT mechanism, count(DISTINCT score) > 1 AS varies, round(max(score), 6) AS peak FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS mechanism, {near_sql(e)} AS score FROM f" for n, e in MECHANISMS.items()) + ") GROUP BY mechanism")
def mechanism_variability(spark, sf_dir):
    """Whether each score varies at all, in one pass over the wide table."""
    s = scores(prints(spark, sf_dir)).agg(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in MECHANISMS])
    rows = F.array(*[F.struct(F.lit(n).alias("mechanism"), (F.col(n)["lo"] < F.col(n)["hi"]).alias("varies"), F.round(F.col(n)["hi"], 6).alias("peak")) for n in MECHANISMS])
    return s.select(F.inline(rows))
