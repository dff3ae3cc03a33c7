"""Query op7_quality: quality rules with certified cutoffs over all documents."""

from pyspark.sql import DataFrame, SparkSession

from .quality import DELTA, RISK, RULES, assess


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(risk: float = RISK, delta: float = DELTA) -> str:
    share = risk / len(RULES)
    value = {r: "coalesce({0}::DOUBLE / nullif({1}, 0)::DOUBLE, 0)".format(*m.split(" / ")) for r, (m, _) in RULES.items()}
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, cs) in RULES.items() for i, c in enumerate(cs))
    longs = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {v} AS value FROM good" for r, v in value.items())
    limits = ", ".join(f"min(CASE WHEN rule = '{r}' THEN cutoff END) AS {r}" for r in RULES)
    reject = " OR ".join(f"coalesce({v} > c.{r}, false)" for r, v in value.items())
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS t FROM words),
doubled AS (
  SELECT *, list_transform(list_filter(map_entries(histogram_), lambda e: e.value > 1), lambda e: e.key) AS d
  FROM (SELECT *, list_histogram(t) AS histogram_ FROM windows)),
places AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: list_contains(d, t[i])) AS p FROM doubled),
measured AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN k = len(p) THEN 3 ELSE least(3, p[k + 1] - p[k]) END)), 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, md5(text) AS digest
  FROM places),
good AS (SELECT DISTINCT * EXCLUDE (doc_id) FROM measured WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
long_ AS ({longs}),
grid AS (SELECT * FROM (VALUES {grid}) AS g(rule, step, cutoff)),
seen AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
  FROM long_ JOIN grid USING (rule) GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN k < n * {share} THEN list_sum(list_transform(range(0, k + 1),
      lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share})))) ELSE 1 END
    <= {delta} / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM long_)) AS passed
  FROM seen),
certified AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM tested),
cuts AS (SELECT stratum, {limits} FROM certified WHERE ok GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({reject}) AS kept
FROM measured m LEFT JOIN cuts c USING (stratum)"""


QUERIES = {"op7_quality": op7_quality}
ORACLES = {"op7_quality": sql()}
