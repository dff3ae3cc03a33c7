"""Query op12_audit: five filters over all documents in each of their 120 orders, by source."""

from pyspark.sql import DataFrame, SparkSession

from .audit import audit


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs.select("doc_id", "text", "source"), labels).drop("filter")


QUERIES = {"op12_audit": op12_audit}
ORACLES = {
    "op12_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
n AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
g AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS past FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
h AS (
  SELECT n.*, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS k FROM n),
j AS (
  SELECT h.part, filter_order, step, x, n, good, toxic, k, fails[x] AS own,
    (a AND contains(past, 'A')) OR (b AND contains(past, 'B')) OR (c AND contains(past, 'C')) OR (d AND contains(past, 'D')) OR (e AND contains(past, 'E')) AS gone
  FROM h, g),
r AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT own), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND own), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND own), 0) AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0) AS unique_fails,
    coalesce(sum(n * good) FILTER (NOT gone AND own), 0) AS good_lost, coalesce(sum(n * toxic) FILTER (NOT gone AND own), 0) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r"""
}
