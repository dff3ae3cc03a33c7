"""Mixing sources to target weights with a cap on repetitions (water-filling), and a seeded sample that meets it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, free_name, materialise, n_words, running_totals

#: Weights of sources in code point order, repeating (null last).
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17


def water_fill(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, weight) with a column ``target`` that shares out the sum of all sizes by weight.

    Sources above ``epochs`` times their size are clamped there and the excess is reshared by weight among the others,
    until none is above. A round is one aggregate over the sources; only its two sums reach the driver.
    """
    at_most = F.col("source_size") * F.lit(float(epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # A source is clamped at this level of words per unit of weight or stays proportional to it.
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= at_most
        clamped, open_ = sources.agg(F.sum(F.when(full, at_most).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not open_:
            break
        now = (total - clamped) / open_
        if level is not None and now <= level:
            break
        level = now
    share = F.least(F.col("weight") * F.lit(float(level or 0.0)), at_most)
    return sources.withColumn("target", share.cast("double"))


def source_table(sized: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, weight) of rows (source, size); the weights repeat in code point order, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_totals(sums, [F.col("source").asc_nulls_last()], "one", "rank")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    return materialise(ranked.select("source", "source_size", weight.alias("weight")), "sources")


def _words(taken: DataFrame) -> DataFrame:
    return taken.groupBy(F.col("source").alias("source_")).agg(F.sum("size").alias("got"))


def _fill(summed: DataFrame, total: str) -> tuple[DataFrame, DataFrame]:
    """(taken, left) of rows with words: those that fit in their source's open part one after the other, and the others.

    ``total``: the sum of sizes before a row, over all sources. In ``left`` the open part is less what was taken.
    """
    starts = materialise(summed.groupBy(F.col("source").alias("source_")).agg(F.min(total).alias("start")), "starts")
    rows = summed.where("size > 0").join(starts, F.col("source").eqNullSafe(F.col("source_")))
    fits = F.col(total) - F.col("start") + F.col("size") <= F.col("open")
    rows = materialise(rows.select("source", "size", "before", "open", fits.alias("fits")), "filled")
    taken = rows.where("fits").select("source", "size", F.col("before").alias("picked"))
    rest = rows.where("NOT fits").drop("fits").join(materialise(_words(taken), "got"), F.col("source").eqNullSafe(F.col("source_")), "left")
    return taken, rest.withColumn("open", F.col("open") - F.coalesce("got", F.lit(0))).drop("source_", "got")


def draw(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``copies`` to rows (id, source, size, source_size, target, digest).

    Every document of a source is taken the whole number of times its target holds the source. For the fractional
    part the source's documents are taken in the order of their seeded hashes as long as they fit in it. Those larger
    than what is still open are passed over and the rest is filled in the same way, until none fits; then the one that
    brings the sum nearest to it is added, if one does. Equal rows are interchangeable.
    """
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(epochs + F.lit(1e-12)).cast("long")).withColumn(
        "part", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # Sums over each source in hash order, across partitions: a running sum over (source, hash) less the source's start.
    order = [F.col("source").asc_nulls_last(), F.xxhash64(F.lit(seed), "id", "digest"), F.col("id"), F.col("digest")]
    summed = materialise(running_totals(rows.withColumn("at", F.col("size")), order, "at", "before"), "filled")
    taken, left = _fill(summed.withColumn("open", F.col("part")), "before")
    picked = [taken]
    while True:
        # Documents with words have places of their own in the running sum, so ``before`` tells them apart.
        fitting = materialise(left.where(F.col("size") <= F.col("open")), "fitting")
        if fitting.isEmpty():
            break
        again = running_totals(fitting, [F.col("source").asc_nulls_last(), F.col("before")], "size", "so_far")
        taken, rest = _fill(again, "so_far")
        picked.append(taken)
        # What didn't fit before may still come nearest in the end; it sees the same open part.
        got = materialise(_words(taken), "got")
        over = left.where(F.col("size") > F.col("open")).join(got, F.col("source").eqNullSafe(F.col("source_")), "left")
        over = over.withColumn("open", F.col("open") - F.coalesce("got", F.lit(0))).drop("source_", "got")
        left = materialise(rest.unionByName(over), "left")
    # No document that is left fits, so one that comes nearer to the target leaves nothing open.
    nearest = left.where(F.col("size") < 2 * F.col("open")).groupBy("source").agg(F.min(F.struct("size", "before")).alias("p"))
    picked.append(nearest.select(F.col("p.before").alias("picked")))
    chosen = materialise(reduce(DataFrame.unionByName, [p.select("picked") for p in picked]), "picks")
    state = summed.join(chosen, (F.col("before") == F.col("picked")) & (F.col("size") > 0), "left")
    state = materialise(state.withColumn("drawn", F.col("picked").isNotNull()).drop("picked", "at"), "drawn")
    return state.withColumn("copies", F.col("whole") + F.col("drawn").cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(id_col, size, source_size, target double, taken long), one row per row of ``docs``.

    Sizes are words of whole texts (null: 0). A null source is a source of its own, after all others. The sum of
    targets is the sum of sizes. No document is taken more than ``epochs`` times. Empty table: empty result.
    """
    text = column(docs, text_col).cast("string")
    sized = docs.select(column(docs, id_col).alias("id"), column(docs, source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("digest"))
    sized = materialise(sized, "sizes")
    targets = water_fill(source_table(sized, weights), epochs).withColumnRenamed("source", "source_")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    found = draw(rows, seed)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken, columns as they were.

    Rows with equal ids, texts and sources share out their copies evenly, in an order that only their columns decide, so
    reruns agree. Null texts and sources are values of their own. Empty table: empty result; columns may have any names.
    """
    named = [free_name(docs, c) for c in ("mix_id_", "mix_a_", "mix_b_", "mix_source_")]
    text, source = column(docs, "text").cast("string"), column(docs, "source").cast("string")
    key = [column(docs, "doc_id"), F.xxhash64(text), F.xxhash64(F.lit(7), text), source]
    sized = docs.select(*[k.alias(n) for k, n in zip(key, named)], n_words(text).alias("size"))
    sized = materialise(sized.groupBy(*named).agg(F.min("size").alias("each"), F.count("*").alias("rows")), "sizes")
    # One row for each document, with its weight in words; rows that are equal are spread over places of their own.
    places = sized.select(*named, "each", "rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth"))
    single = places.select(F.struct(*named).alias("id"), F.col(named[3]).alias("source"), F.col("each").alias("size"), F.col("nth").alias("digest"))
    targets = water_fill(source_table(single, weights), epochs).withColumnRenamed("source", "source_")
    found = draw(single.join(targets, F.col("source").eqNullSafe(F.col("source_"))).drop("source_"), seed)
    copies, rows = free_name(docs, "mix_copies_"), free_name(docs, "mix_rows_")
    counts = found.groupBy("id").agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    counts = materialise(counts.select(*[F.col("id").getField(n).alias(n) for n in named], copies, rows), "copies")
    same = [k.eqNullSafe(F.col(n)) for k, n in zip(key, named)]
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    alone = docs.join(counts.where(F.col(rows) == 1), same).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(free_name(docs, "mix_nth_")), *names).select(*names)
    several = counts.where(F.col(rows) > 1)
    if several.isEmpty():
        return alone
    # Equal rows are one with their number; of a key's different rows each gets its part of the key's copies.
    row = F.struct(*[column(docs, c) for c in docs.columns]).alias("row")
    equal = docs.join(several, same).select(row, *named, copies, rows).groupBy("row", *named, copies, rows).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*named).orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, 0))
    part = lambda at: F.floor(F.col(copies) * at / F.col(rows))
    shared = equal.withColumn("upto", upto).withColumn("own", (part(F.col("upto")) - part(F.col("upto") - F.col("n"))).cast("long"))
    spread = shared.where("own > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own"))))
    return alone.unionByName(spread.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
