"""Query op5_urllists: every page judged by list entries active on the day it was fetched.

``pages`` has no fetch day and there is no list table, so both are derived from all pages: a page is fetched on day
``page_id * 37 % 720`` of 2023 and 2024. Every page also makes a list entry: ids divisible by 3 name the page's URL,
those that leave 1 its host, those that leave 2 the host's parent domain; days and actions come from the id too.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .urllists import bare_url, host_of, judge

START = "2023-01-01"


def entries(pages: DataFrame) -> DataFrame:
    host, i = host_of(F.col("url")), F.col("page_id")
    parent = F.regexp_replace(host, r"^[^.]*\.", "")
    kind = F.expr("CASE pmod(page_id, 3) WHEN 0 THEN 'url' WHEN 1 THEN 'host' ELSE 'domain' END")
    key = F.when(i % 3 == 0, bare_url(F.col("url"))).when(i % 3 == 1, host).otherwise(parent)
    action = F.expr("CASE pmod(page_id * 11, 7) WHEN 0 THEN 'remove' WHEN 1 THEN 'remove' WHEN 2 THEN 'allow' ELSE 'block' END")
    return pages.select(kind.alias("kind"), key.alias("key"), F.expr(f"date_add(DATE'{START}', CAST(pmod(page_id * 53, 720) AS INT))").alias("day"), action.alias("action"))


def op5_urllists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.expr(f"date_add(DATE'{START}', CAST(pmod(page_id * 37, 720) AS INT))")
    captures = pages.select(F.col("page_id").alias("capture"), "url", fetched.alias("fetched"))
    return judge(captures, entries(pages)).withColumnRenamed("capture", "page_id")


QUERIES = {"op5_urllists": op5_urllists}
ORACLES = {
    "op5_urllists": rf"""
WITH p AS (
  SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '(:[0-9]*)?\.?$', '')) AS host
  FROM pages),
e AS (
  SELECT CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'host' ELSE 'domain' END AS kind,
    CASE page_id % 3 WHEN 0 THEN bare WHEN 1 THEN host ELSE regexp_replace(host, '^[^.]*\.', '') END AS key,
    DATE '{START}' + (page_id * 53 % 720)::INT AS day,
    CASE page_id * 11 % 7 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS a
  FROM p),
daily AS (SELECT kind, key, day, max(a) AS a FROM e WHERE kind IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS till FROM daily),
named AS (
  SELECT page_id, 'url' AS kind, bare AS key, 0 AS rank FROM p
  UNION ALL SELECT page_id, 'host', host, 1 FROM p WHERE host <> ''
  UNION ALL SELECT page_id, 'domain', array_to_string(l[i + 1:], '.'), i + 2
    FROM (SELECT page_id, l, unnest(range(0, len(l) - 1)) AS i FROM (SELECT page_id, string_split(host, '.') AS l FROM p WHERE host <> ''))),
hits AS (
  SELECT n.page_id, n.rank, s.kind, s.key, s.a, s.day
  FROM named n JOIN spans s ON n.kind = s.kind AND n.key = s.key AND s.a < 2
   AND s.day <= DATE '{START}' + (n.page_id * 37 % 720)::INT AND (s.till IS NULL OR DATE '{START}' + (n.page_id * 37 % 720)::INT < s.till)),
best AS (SELECT page_id, min_by({{'a': a, 'kind': kind, 'key': key, 'day': day}}, rank) AS m FROM hits GROUP BY page_id)
SELECT p.page_id, DATE '{START}' + (p.page_id * 37 % 720)::INT AS fetched,
  CASE m.a WHEN 0 THEN 'block' ELSE 'allow' END AS verdict, m.kind AS matched_kind, m.key AS matched_key, m.day AS valid_from
FROM p LEFT JOIN best USING (page_id)"""
}
