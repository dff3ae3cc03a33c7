"""Interaction of filters: what each removes in every order, counted from the combinations of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, column, materialise

#: Filters whose failure is seen in a document alone, by letter; COPY's needs the whole table.
LOCAL, COPY = "ABCD", "E"
LETTERS = LOCAL + COPY


def failures(text: Column) -> dict[str, Column]:
    """Failure of each local filter for a text that isn't null."""
    words = F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def copies(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, hash, text, ...) whose very text a row with a smaller doc_id has, repeated rows included.

    A left-semi join on hash, exact text and smaller doc_id. Its right side holds one row per distinct text, the
    smallest id, added up before the shuffle: some smaller id has the text exactly if the smallest one does, and a group of copies
    of any size meets one row. Spark may split the left side of a crowded hash, as nothing else needs it together.
    Null ids are no smaller than any other and have no smaller one.
    """
    first = rows.groupBy("hash", "text").agg(F.min("doc_id").alias("first_id"))
    l, r = rows.alias("l"), first.alias("r")
    same = (F.col("l.hash") == F.col("r.hash")) & (F.col("l.text") == F.col("r.text")) & (F.col("r.first_id") < F.col("l.doc_id"))
    return l.join(r.hint("merge"), same, "left_semi")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by source and by the set of filters they fail, bit i of mask for letter i.

    ``docs`` needs doc_id, text, source; ``labels`` doc_id, quality, toxic. Null texts are empty, a null source is the part ''.
    Repeated rows count each; rows of one id with different texts are told apart by the text's hash. A document is good
    (toxic) if any of its labels says so; ids that are null have none.
    """
    text = F.coalesce(column(docs, "text").cast("string"), F.lit(""))
    keys = [column(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(column(docs, "source").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("hash")]
    bits = sum((F.when(f, 1 << LETTERS.index(k)).otherwise(0) for k, f in failures(F.col("text")).items()), F.lit(0))
    alone = docs.select(*keys, text.alias("text")).select("doc_id", "part", "hash", bits.alias("mask"), F.lit(1).alias("n"))
    copied = copies(docs.select(*keys, text.alias("text"))).select("doc_id", "part", "hash", F.lit(1 << LETTERS.index(COPY)).alias("mask"), F.lit(0).alias("n"))
    failed = alone.unionByName(copied).groupBy("doc_id", "part", "hash").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    marked = failed.join(marks, "doc_id", "left")
    return marked.groupBy("part", "mask", zero("good"), zero("toxic")).agg(F.sum("n").alias("n"))


def orders(combined: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``combinations``.

    (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley). All follow
    from the documents that pass each of the 32 sets of filters: a part has those as three arrays, and its 600 rows only
    look them up. No part: no row.
    """
    sets = range(1 << len(LETTERS))
    passing = lambda of: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, of).otherwise(0)) for s in sets])
    n = F.col("n")
    parts = combined.groupBy("part").agg(
        passing(n).alias("passing"), passing(n * F.col("good")).alias("passing_good"), passing(n * F.col("toxic")).alias("passing_toxic"),
        F.array(*[F.sum(F.when(F.col("mask") == s, n).otherwise(0)) for s in sets]).alias("exactly"),
    )
    letters = F.array(*map(F.lit, LETTERS))
    rest = lambda done: F.filter(letters, lambda c: F.instr(done, c) == 0)
    grown = F.array(F.lit(""))
    for _ in LETTERS:
        grown = F.flatten(F.transform(grown, lambda done: F.transform(rest(done), lambda c: F.concat(done, c))))
    steps = F.sequence(F.lit(1), F.lit(len(LETTERS)))
    each = parts.withColumn("filter_order", F.explode(grown)).withColumn("step", F.explode(steps))
    before = sum((F.when(F.expr(f"locate('{c}', filter_order) < step"), 1 << i).otherwise(0) for i, c in enumerate(LETTERS)), F.lit(0))
    placed = each.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("bit", F.expr(f"CAST(power(2, locate(filter, '{LETTERS}') - 1) AS INT)")).withColumn("before", before)
    at = lambda array, s: F.get(F.col(array), s)
    lost = lambda array: at(array, F.col("before")) - at(array, F.col("before").bitwiseOR(F.col("bit")))
    failing = at("passing", F.lit(0)) - at("passing", F.col("bit"))
    # Orders in which exactly the set s stands before the filter: |s|! (4 - |s|)!
    weight = "element_at(array(24, 6, 4, 6, 24), bit_count(s) + 1)"
    shapley = F.expr(f"aggregate(filter(sequence(0, {len(sets) - 1}), s -> (s & bit) = 0), 0L, (t, s) -> t + {weight} * (passing[s] - passing[s | bit]))")
    return placed.select(
        "part", "filter_order", "step", "filter", at("passing", F.col("before").bitwiseOR(F.col("bit"))).alias("kept"), lost("passing").alias("removed"),
        (failing - lost("passing")).alias("redundant"), at("exactly", F.col("bit")).alias("unique_fails"), lost("passing_good").alias("good_lost"),
        lost("passing_toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``orders`` of the ``combinations`` of all ``docs``, in between written once; other columns may have any names."""
    return orders(materialise(combinations(docs, labels), "combinations"))
