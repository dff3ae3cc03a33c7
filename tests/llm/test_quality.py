import math
import random
from collections import Counter

import pytest

from barwright.llm import quality
from barwright.llm.q07_quality import ORACLES, op7_quality, sql
from tests.llm.oracle import rows_of_query, rows_of_sql, same


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf_dir):
    same(spark, sf_dir, op7_quality, ORACLES["op7_quality"])


def brute_repeats(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    t = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(t)
    return len({i + k for i, x in enumerate(t) if n[x] > 1 for k in range(3)})


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.n_repeat_words for r in quality.assess(docs, labels).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "k", "p"), [(100, 0, 0.02), (1000, 7, 0.02), (200000, 700, 0.004), (10, 5, 0.02), (5, 0, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.sql(f"SELECT {quality.tail('n', 'k', p)} AS x FROM VALUES ({n}L, {k}L) AS t(n, k)").first().x
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p) for j in range(k + 1)]
    want = math.fsum(math.exp(x) for x in logs) if k < n * p else 1
    assert got == pytest.approx(want, rel=1e-6)


def test_certified_cutoffs_reject_few_good_documents(spark):
    """With enough labels the noise rule is certified and what it rejects is labelled bad; sf0.1 has enough for English."""
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op7_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    fresh = [r for r in labels if not rows[r.doc_id].base_failed]
    good, bad = ([r for r in fresh if r.quality == q] for q in (1, 0))
    assert sum(not rows[r.doc_id].kept for r in good) <= quality.RISK * len(good)
    assert sum(not rows[r.doc_id].kept for r in bad) >= 0.3 * len(bad)


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "word " * 60, "en"), (4, "a b c " * 30000, "xx"), (5, "one\none\n\n \n\n two", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n_words", "2 AS stratum", "3 AS row")
    labels = spark.createDataFrame([(2, None, None), (5, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(docs, labels).collect()}
    assert [got[i].n_words for i in (1, 2, None, 4, 5)] == [0, 0, 60, 90000, 3]
    assert got[5].n_dup_lines == 1 and got[4].n_repeat_words == 90000 and got[None].base_failed
    distinct = " ".join(f"w{i}" for i in range(80))
    more = docs.unionByName(spark.createDataFrame([(9, distinct, None, 1, 2, 3), (9, distinct, None, 1, 2, 3)], docs.schema))
    kept = quality.keep_documents(more, labels).collect()
    assert [r.doc_id for r in kept] == [9, 9] and list(kept[0].asDict()) == more.columns
    assert quality.keep_documents(docs.limit(0), labels).collect() == []
    assert quality.assess(docs.limit(0), labels.limit(0)).collect() == []


def test_languages_with_few_labels_have_cutoffs_in_the_pipeline(spark):
    """One joint sequence certifies what single rules can't: bad documents of sf0.1 that stay, by language."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_documents(docs, labels).select("doc_id").collect()}
    passed = {r.doc_id for r in quality.assess(docs, labels.limit(0)).where("NOT base_failed").select("doc_id").collect()}
    marks = labels.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality").distinct().collect()
    n, stay = (Counter((r.lang, r.quality) for r in marks if r.doc_id in some) for some in (passed, kept))
    assert {lang: n[lang, 0] for lang in ("de", "en", "es", "fr")} == {"de": 50, "en": 166, "es": 32, "fr": 43}
    assert {lang: stay[lang, 0] for lang in ("de", "en", "es", "fr")} == {"de": 20, "en": 0, "es": 17, "fr": 22}
    assert all(n[lang, 1] - stay[lang, 1] <= quality.RISK * n[lang, 1] for lang in ("de", "en", "es", "fr"))
