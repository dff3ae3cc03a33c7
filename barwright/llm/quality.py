"""Quality rules whose cutoffs are certified on labelled documents. DataFrame functions only.

A rule rejects documents whose measure is above a cutoff. For each stratum (language) and rule a fixed list of cutoffs
is tested from lenient to strict against documents labelled good. A cutoff passes if, were its true rate of false
rejections above the rule's share of ``risk``, so few false rejections would be seen with a probability of at most
``delta`` over the number of (stratum, rule) pairs: the exact binomial tail, Bonferroni over pairs. Testing stops at
the first that fails (a fixed sequence needs no correction of its own), and the strictest that passed counts. So with
probability 1 - ``delta`` no stratum loses more than ``risk`` of its good documents to all rules together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, column, materialise

#: Fixed before any label is seen: each rule's measure and its cutoffs from lenient to strict.
FRACTIONS = [0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]
RULES = {
    "symbols": ("n_symbols / word_chars", FRACTIONS),
    "dup_lines": ("n_dup_lines / n_lines", FRACTIONS),
    "repeats": ("n_repeat_words / n_words", FRACTIONS),
    "capitals": ("n_capitals / word_chars", FRACTIONS),
    "word_length": ("word_chars / n_words", [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.0]),
}
RISK, DELTA = 0.02, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
#: Rows of the cutoff table up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000

# Of a sorted array s of (hash of a three-word window, place): the sorted places whose hash occurs again.
_PLACES = """array_sort(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 AND s[greatest(k - 1, 0)].h = s[k].h)
    OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = s[k].h)), k -> s[k].at))"""
# Words that windows at the sorted places p cover: each window adds what lies before the next one, three at most.
_COVERED = "aggregate(sequence(1, size(p) - 1), 3, (n, k) -> n + least(3, p[k] - p[k - 1]))"


def measure(df: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(row, stratum, digest, counts): ``row`` is the struct of ``df``'s columns, the counts are long.

    Words are runs without U+0020 and U+0009 to U+000D, over the whole text; null text: no words, all counts 0.
    ``n_dup_lines`` counts lines with a word that equal an earlier one, ``n_repeat_words`` the words inside
    three-word windows that occur twice or more in the text, the first time included (windows are told apart by
    64-bit hashes). The stratum of a null language is its own. ``digest`` is a 64-bit hash of the text.
    """
    row = F.struct(*[column(df, c) for c in df.columns])
    base = df.select(row.alias("row"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-")).alias("stratum"))
    split = base.select(
        "row", "stratum", "text",
        F.expr(rf"array_remove(split(text, '[{SPACE}]+', -1), '')".replace("\\", "\\\\")).alias("words"),
        F.expr(rf"filter(split(text, '\n', -1), l -> l RLIKE '[^{SPACE}]')".replace("\\", "\\\\")).alias("lines"),
    )
    windows = split.select(
        "row", "stratum", "text", "words", "lines",
        F.expr("IF(size(words) < 3, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("windows"),
    )
    repeats = f"""IF(size(array_distinct(windows)) = size(windows), 0,
        transform(transform(array(array_sort(transform(windows, (h, at) -> struct(h AS h, at AS at)))), s -> {_PLACES}), p -> {_COVERED})[0])"""
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.expr(repeats),
        "n_lines": F.size("lines"),
        "n_capitals": F.regexp_count("text", F.lit("[A-Z]")),
    }
    # As the one row of an inlined array: filters and rules above then read the counts and never compute them again.
    one = F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])
    return windows.select("row", "stratum", F.xxhash64("text").alias("digest"), F.inline(F.array(one)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def tail(n: str, k: str, p: float) -> str:
    """SQL for P(X <= k) of a binomial X(n, p) where k < n p, and 1 elsewhere.

    The largest term times the sum of the others relative to it, so that nothing underflows on the way.
    """
    log_top = f"aggregate(IF({k} = 0, CAST(array() AS ARRAY<BIGINT>), sequence(1L, {k})), 0D, (a, j) -> a + ln(({n} - j + 1) / j)) + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D)"
    below = f"""aggregate(IF({k} = 0, CAST(array() AS ARRAY<BIGINT>), sequence({k}, 1L, -1L)), named_struct('t', 1D, 's', 1D),
        (a, j) -> named_struct('t', a.t * (j / ({n} - j + 1)) * ((1 - {p}D) / {p}D), 's', a.s + a.t * (j / ({n} - j + 1)) * ((1 - {p}D) / {p}D)), a -> a.s)"""
    return f"IF({k} < {n} * {p}D, exp({log_top}) * {below}, 1D)"


def cutoffs(measured: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs, one row per stratum: (stratum, one column per rule, null where none passed).

    ``measured``: stratum and counts of the documents labelled good, all of them. No such documents: no row.
    """
    spark, share = measured.sparkSession, risk / len(RULES)
    values = ", ".join(f"('{r}', {i}, {c}D, {len(cs)})" for r, (_, cs) in RULES.items() for i, c in enumerate(cs))
    grid = spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, step, cutoff, steps)")
    above = [F.struct(F.lit(r).alias("rule"), sum(((_value(r) > c).cast("int") for c in cs), F.lit(0)).alias("above")) for r, (_, cs) in RULES.items()]
    counts = measured.select("stratum", F.explode(F.array(*above)).alias("m")).groupBy("stratum", "m.rule", "m.above").agg(F.count("*").alias("n"))
    counts = materialise(counts, "rejections")
    pairs = counts.select("stratum", "rule").distinct().count()
    if not pairs:
        pairs = 1
    seen = counts.join(F.broadcast(grid), "rule").groupBy("stratum", "rule", "step", "cutoff").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("above") >= F.col("steps") - F.col("step"), F.col("n")).otherwise(0)).alias("k")
    )
    passed = seen.withColumn("passed", F.expr(tail("n", "k", share)) <= delta / pairs)
    order = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    certified = passed.withColumn("certified", F.min("passed").over(order)).where("certified")
    best = [F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES]
    return materialise(certified.groupBy("stratum").agg(*best), "cutoffs")


def joint_cutoffs(measured: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs as ``cutoffs`` has them, but of all rules together: one fixed sequence a stratum.

    Step i rejects what any rule rejects at its i-th cutoff (its last one where it has fewer). A step is tested by its
    documents rejected at the whole of ``risk``, with ``delta`` over the strata alone; testing stops at the first that
    fails. ``measured``: good documents that the base rule passes; with probability 1 - ``delta`` no stratum loses more
    than ``risk`` of these. Some 250 good labels can be enough for that, where ``cutoffs`` needs 1,500.
    """
    steps = [[cs[min(i, len(cs) - 1)] for _, cs in RULES.values()] for i in range(max(len(cs) for _, cs in RULES.values()))]
    rejected = [reduce(lambda a, b: a | b, [_value(r) > c for r, c in zip(RULES, step)]) for step in steps]
    above = sum((x.cast("int") for x in rejected), F.lit(0))  # cutoffs only grow stricter, so these are the last steps
    counts = materialise(measured.select("stratum", above.alias("above")).groupBy("stratum", "above").agg(F.count("*").alias("n")), "rejections")
    strata = counts.select("stratum").distinct().count() or 1
    values = ", ".join(f"({i}, " + ", ".join(f"{c}D" for c in step) + ")" for i, step in enumerate(steps))
    grid = measured.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(step, {', '.join(RULES)})")
    seen = counts.crossJoin(F.broadcast(grid.select("step"))).groupBy("stratum", "step").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("above") >= len(steps) - F.col("step"), F.col("n")).otherwise(0)).alias("k")
    )
    passed = seen.withColumn("passed", F.expr(tail("n", "k", risk)) <= delta / strata)
    order = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    certified = passed.withColumn("certified", F.min("passed").over(order)).where("certified")
    last = certified.groupBy("stratum").agg(F.max("step").alias("step"))
    return materialise(last.join(F.broadcast(grid), "step").select("stratum", *RULES), "cutoffs")


def certified_cutoffs(measured: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``cutoffs`` where a stratum has labels enough for any of them, else ``joint_cutoffs``; each has half of ``delta``."""
    single = cutoffs(measured, risk, delta / 2)
    joint = joint_cutoffs(measured.where(~base_failed()), risk, delta / 2)
    return materialise(single.unionByName(joint.join(single.select("stratum"), "stratum", "left_anti")), "cutoffs")


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to measured rows."""
    small = limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rejected = F.lit(False)
    for r in RULES:
        rejected |= F.coalesce(_value(r) > F.col(r), F.lit(False))
    joined = measured.join(F.broadcast(limits) if small else limits, "stratum", "left")
    return joined.select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids with a label of good quality; of contradicting labels the good one counts."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("labelled")).distinct()


def labelled_good(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, counts) of the measured rows (doc_id, stratum, digest, counts) with a good label, each text once.

    Copies of a text are no draws of their own: counted each, they would make the binomial bound too sure.
    """
    good = measured.join(good_documents(labels), F.col("doc_id") == F.col("labelled"), "left_semi")
    return good.select("stratum", "digest", *COUNTS).distinct().drop("digest")


def assess(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of ``docs`` (doc_id, text, lang).

    Repeated rows are judged alike, and copies of a text count once for the cutoffs; null ids are never labelled. Without labels, or
    with too few in a stratum to certify anything, only the base rule rejects.
    """
    measured = measure(docs.select("doc_id", "text", "lang"), column(docs, "text"), column(docs, "lang"))
    measured = materialise(measured.select(F.col("row.doc_id").alias("doc_id"), "stratum", "digest", *COUNTS), "measures")
    return judge(measured, cutoffs(labelled_good(measured, labels), risk, delta)).drop("stratum", "digest")


def keep_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a certified cutoff rejects, columns as they were.

    Null and empty texts have no words and go. Repeated rows are judged alike and all stay or go. Without labels only the
    base rule rejects. Empty table: empty result; other columns may have any names. Rows are written once with their
    measures, so nothing is measured twice, and only measures take part in the join with the labels.
    """
    rows = materialise(measure(docs, column(docs, "text"), column(docs, "lang")), "measures")
    measured = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "stratum", "digest", *COUNTS)
    kept = judge(rows, certified_cutoffs(labelled_good(measured, labels), risk, delta)).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
