"""Query op1_warc: all pages through WARC archives with one gzip member per record."""

from pyspark.sql import DataFrame, SparkSession

from .warc import archive_pages


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
bits AS (SELECT *, CAST(unhex(sha1(h)) AS BIT)::VARCHAR AS b FROM p),
coded AS (
  SELECT page_id, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    16 * substr(b, (5 * i + 1)::INT, 1)::INT + 8 * substr(b, (5 * i + 2)::INT, 1)::INT + 4 * substr(b, (5 * i + 3)::INT, 1)::INT
    + 2 * substr(b, (5 * i + 4)::INT, 1)::INT + substr(b, (5 * i + 5)::INT, 1)::INT)::INT, 1)), '') AS d
  FROM bits),
ranked AS (SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS f FROM coded WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN f END AS refers_to
FROM ranked"""
}
