"""Listings and companies from claims that events make: the type is the source, the user the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.identity import listings
from ..sources.tables import tape
from .registry import query

#: Exchange, company and sector that an event claims; now and then wrong, now and then none.
CLAIMS = {
    "exchange": "CASE WHEN k % 5 = 0 THEN NULL WHEN symbol % 4 = 0 AND k % 2 = 0 THEN 'YY' ELSE 'XX' END",
    "company_id": "CASE WHEN source = 'view' AND symbol % 6 = 0 THEN concat('K', symbol % 7) WHEN source IN ('view', 'signup') THEN concat('K', symbol) END",
    "sector": "CASE WHEN source = 'click' AND symbol % 5 = 1 THEN 'S9' ELSE concat('S', symbol % 3) END",
}


def claimed(spark, sf_dir) -> DataFrame:
    t = tape(spark, sf_dir)
    attributes = F.create_map(*[c for n in ("company_id", "sector") for c in (F.lit(n), F.expr(CLAIMS[n]))])
    return t.select("source", F.expr(CLAIMS["exchange"]).alias("exchange"), F.concat(F.lit("C"), "symbol").alias("code"), F.to_date("t").alias("as_of"), attributes.alias("attributes"))


@query(f"""WITH RECURSIVE c AS (SELECT source, {CLAIMS['exchange']} AS exchange, concat('C', symbol) AS code, CAST(t AS DATE) AS as_of, {CLAIMS['company_id']} AS company_id, {CLAIMS['sector']} AS sector
  FROM (SELECT user_id AS symbol, ts AS t, event_type AS source, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)),
only_ AS (SELECT code, min(exchange) AS e FROM c GROUP BY code HAVING min(exchange) = max(exchange)),
p AS (SELECT source, coalesce(exchange, e) AS exchange, code, as_of, company_id, sector, exchange IS NULL AS inferred FROM c LEFT JOIN only_ USING (code)),
q AS (SELECT * FROM p WHERE exchange IS NOT NULL),
said AS (SELECT exchange, code, source, as_of, 'company_id' AS attribute, company_id AS value FROM q WHERE company_id IS NOT NULL UNION ALL SELECT exchange, code, source, as_of, 'sector', sector FROM q WHERE sector IS NOT NULL),
word AS (SELECT exchange, code, attribute, source, min(value) AS value FROM (SELECT *, rank() OVER (PARTITION BY exchange, code, attribute, source ORDER BY as_of) AS r FROM said) WHERE r = 1 GROUP BY ALL),
r AS (SELECT exchange, code, attribute, min(value) AS lo, max(value) AS hi FROM word GROUP BY ALL),
a AS (SELECT exchange, code, count(*) FILTER (lo <> hi) AS conflicts, count(*) FILTER (lo <> hi AND attribute = 'company_id') AS critical, max(lo) FILTER (attribute = 'company_id' AND lo = hi) AS company_id FROM r GROUP BY ALL),
l AS (SELECT exchange, code, count(DISTINCT source) AS n, min(as_of) AS first_seen, max(as_of) AS last_seen, bool_and(inferred) AS inferred FROM q GROUP BY ALL),
there AS (SELECT DISTINCT source FROM q WHERE as_of = (SELECT max(as_of) FROM q)),
still AS (SELECT DISTINCT exchange, code, source FROM q WHERE as_of = (SELECT max(as_of) FROM q)),
gone AS (SELECT exchange, code, count(*) AS absent FROM (SELECT DISTINCT exchange, code, source FROM q) JOIN there USING (source) WHERE (exchange, code, source) NOT IN (SELECT (exchange, code, source) FROM still) GROUP BY ALL),
rows_ AS (SELECT l.*, coalesce(absent, 0) AS absent, coalesce(critical, 0) = 0 AS resolved, coalesce(conflicts, 0) AS conflicts, company_id, l.exchange || ':' || l.code AS listing FROM l LEFT JOIN a USING (exchange, code) LEFT JOIN gone USING (exchange, code)),
link AS (SELECT x.listing AS u, y.listing AS v FROM rows_ x JOIN rows_ y ON x.code = y.code OR (x.exchange = y.exchange AND x.company_id = y.company_id)),
reach AS (SELECT u, v FROM link UNION SELECT r.u, k.v FROM reach r JOIN link k ON k.u = r.v)
SELECT exchange, code, n, first_seen, last_seen, inferred, absent, resolved, conflicts, company_id, company FROM rows_ JOIN (SELECT u AS listing, min(v) AS company FROM reach GROUP BY u) USING (listing)""")
def identity_listings(spark, sf_dir):
    """Every listing with its sources, days, conflicts and the company it belongs to by codes and company ids."""
    found = listings(claimed(spark, sf_dir), ["company_id"], "company_id")
    count = lambda c: F.size(c).cast("long")
    return found.select("exchange", "code", count("sources").alias("n"), "first_seen", "last_seen", "inferred", count("absent").alias("absent"), "resolved", "conflicts", "company_id", "company")
