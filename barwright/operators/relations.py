"""Relations of fields to an outcome as a tree of minimum description length, grown level by level.

A node is split by the field and cut that code its outcomes, and the split itself, in the fewest bits; it stays a leaf unless
that is strictly fewer than without a split. Every depth is one grouped pass over (node, field, value, outcome) counts of all open
nodes. Cuts of a numeric field are scored from prefix sums over its distinct values, in ranges fixed at the start, so no task
holds a node's or field's values whole; the sum over outcomes of n log2 n is carried along as differences, so the number
of outcomes doesn't multiply rows.

Bits are compared at six decimals. Nothing is tunable: the code of a split is one bit, the field's index among those left, the
cut's index among those the values allow, and the number of branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import sums_before
from .shared import checkpointed

#: Ranges that a numeric field's values are dealt into.
RANGES = 64
#: Rows of a level's splits up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 10_000
MISSING = "MISSING"


def n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(0.0)


def integer_bits(n: Column) -> Column:
    """Code length of a positive integer."""
    return 1 + F.log2(F.greatest(n, F.lit(1)).cast("double"))


def index_bits(n: Column) -> Column:
    return F.log2(F.greatest(n, F.lit(1)).cast("double"))


def outcome_bits(n: Column, kinds: Column, summed: Column) -> Column:
    """Bits of n outcomes of so many kinds, ``summed`` being the sum of n log2 n over kinds."""
    return F.when(n <= 1, 0.0).otherwise(integer_bits(kinds) + n_log_n(n) - summed)


def described(counts: DataFrame, by: list[str], name: str = "bits") -> DataFrame:
    """(by, n, ``name``): cases and outcome bits of each group of ``counts`` (by, outcome, n)."""
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(n_log_n(F.col("n"))).alias("s")).select(
        *by, "n", "kinds", outcome_bits(F.col("n"), F.col("kinds"), F.col("s")).alias(name)
    )


def open_cases(cases: DataFrame, outcome: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(node, outcome, left, values): every case at the root, its fields as a map of (x, text, range).

    A null or NaN value is missing; a null outcome is an outcome of its own.
    """
    exact = [F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), [i / RANGES for i in range(1, RANGES)], 10_000).alias(f) for f in numeric]
    cuts = cases.agg(*exact).first() if numeric else []  # RANGES numbers a field
    none = F.lit(None)

    def value(f: str) -> Column:
        x = F.nanvl(F.col(f).cast("double"), none.cast("double")) if f in numeric else none.cast("double")
        bounds = sorted(set(cuts[numeric.index(f)] or [])) if f in numeric else []
        place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda c: c <= x)) if bounds else F.lit(0)
        return F.struct(x.alias("x"), (none if f in numeric else F.col(f)).cast("string").alias("text"), place.cast("int").alias("place"))

    fields = sorted([*numeric, *categorical])
    pairs = [c for f in fields for c in (F.lit(f), value(f))]
    return cases.select(
        F.lit("").alias("node"), F.coalesce(F.col(outcome).cast("string"), F.lit("NULL")).alias("outcome"), F.array(*map(F.lit, fields)).alias("left"),
        F.create_map(*pairs).alias("values"),
    )


def field_counts(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """(node, n_left, field, is_number, x, text, place, outcome, n): the one grouped pass of a level."""
    field = F.explode("left").alias("field")
    long = rows.select("node", F.size("left").alias("n_left"), field, "values", "outcome").withColumn("v", F.element_at("values", F.col("field")))
    keys = ["node", "n_left", "field", F.col("field").isin(*numeric).alias("is_number"), "v.x", "v.text", "v.place", "outcome"]
    return long.select(*keys).groupBy("node", "n_left", "field", "is_number", "x", "text", "place", "outcome").agg(F.count("*").alias("n"))


def category_splits(counts: DataFrame) -> DataFrame:
    """(node, field, cut, candidates, bits) of the split of each field that is no number by each of its values; missing is one of them."""
    part = described(counts.where("NOT is_number").groupBy("node", "n_left", "field", "text", "outcome").agg(F.sum("n").alias("n")), ["node", "n_left", "field", "text"])
    whole = part.groupBy("node", "n_left", "field").agg(F.count("*").alias("branches"), F.sum("bits").alias("bits")).where("branches > 1")
    bits = 1 + index_bits(F.col("n_left")) + integer_bits(F.col("branches")) + F.col("bits")
    return whole.select("node", "field", F.lit(None).cast("double").alias("cut"), F.lit(1).cast("long").alias("candidates"), bits.alias("bits"))


def number_splits(counts: DataFrame) -> DataFrame:
    """(node, field, cut, candidates, bits) of every cut half-way between neighbouring values of each numeric field of each node.

    Cases without a value are a branch of their own.
    """
    seen, by = counts.where("is_number"), ["node", "n_left", "field"]
    there = seen.where("x IS NOT NULL")
    totals = there.groupBy(*by, "outcome").agg(F.sum("n").alias("of_outcome"))
    run = sums_before(there, "x", {"before": "n"}, [*by, "outcome"], place=F.col("place")).join(totals, [*by, "outcome"])
    after = F.col("before") + F.col("n")
    rest_before, rest = F.col("of_outcome") - F.col("before"), F.col("of_outcome") - after
    moved = run.groupBy(*by, "x", "place").agg(
        F.sum("n").alias("here"), F.sum((F.col("before") == 0).cast("long")).alias("started"), F.sum((rest == 0).cast("long")).alias("ended"),
        F.sum(n_log_n(after) - n_log_n(F.col("before"))).alias("gained"), F.sum(n_log_n(rest) - n_log_n(rest_before)).alias("given"),
    )
    sums = {"n0": "here", "k0": "started", "e0": "ended", "s0": "gained", "r0": "given", "c0": "one"}
    placed = sums_before(moved.withColumn("one", F.lit(1)), "x", sums, by, place=F.col("place"))
    whole = totals.groupBy(*by).agg(F.sum("of_outcome").alias("n"), F.count("*").alias("kinds"), F.sum(n_log_n(F.col("of_outcome"))).alias("s"))
    values = moved.groupBy(*by).agg(F.count("*").alias("distinct_values"))
    lost = described(seen.where("x IS NULL"), by, "missing_bits").drop("n", "kinds")
    # The next larger value: within a range the next row, at its end the first of the next range.
    firsts = moved.groupBy(*by, "place").agg(F.min("x").alias("first_x"))
    ahead = F.expr("min(first_x) OVER (PARTITION BY node, n_left, field ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
    nexts = firsts.withColumn("next_first", ahead).drop("first_x")
    inside = F.expr("lead(x) OVER (PARTITION BY node, n_left, field, place ORDER BY x)")
    cut = placed.join(nexts, [*by, "place"]).withColumn("next_x", F.coalesce(inside, F.col("next_first"))).where("next_x IS NOT NULL")
    cut = cut.join(whole, by).join(values, by).join(lost, by, "left")
    n1 = F.col("n0") + F.col("here")
    left = outcome_bits(n1, F.col("k0") + F.col("started"), F.col("s0") + F.col("gained"))
    right = outcome_bits(F.col("n") - n1, F.col("kinds") - F.col("e0") - F.col("ended"), F.col("s") + F.col("r0") + F.col("given"))
    candidates = F.col("distinct_values") - 1
    branches = F.when(F.col("missing_bits").isNull(), 2).otherwise(3)
    bits = 1 + index_bits(F.col("n_left")) + index_bits(candidates) + integer_bits(branches) + left + right + F.coalesce("missing_bits", F.lit(0.0))
    return cut.select("node", "field", ((F.col("x") + F.col("next_x")) / 2).alias("cut"), candidates.alias("candidates"), bits.alias("bits"))


def best_splits(rows: DataFrame, numeric: list[str], by: list[str]) -> DataFrame:
    """(by, field, cut, candidates, bits): the split of the fewest bits; equal ones give the first field, then the smallest cut."""
    counts = checkpointed(field_counts(rows, numeric))
    splits = category_splits(counts).unionByName(number_splits(counts))
    first = F.min(F.struct(F.round("bits", 6).alias("bits"), "field", "cut", "candidates")).alias("b")
    return splits.groupBy(*by).agg(first).select(*[c for c in by if c != "field"], "b.field", "b.cut", "b.candidates", "b.bits")


def grow_tree(cases: DataFrame, outcome: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """The tree's nodes: (node, depth, cases, outcome_kinds, leaf_bits, field, cut, candidates, split_bits).

    ``node`` is the path from the root '' of '/field<=cut', '/field>cut', '/field=value' and '/field=MISSING'; a leaf has a null
    field. Each field is used once on a path, so there are as many levels as fields at most. The cases left in open nodes are
    checkpointed (``spark.checkpoint.dir``) at each level, and what is done with leaves drops out. No case: no node.
    """
    rows, nodes, depth = checkpointed(open_cases(cases, outcome, numeric, categorical)), None, 0
    while True:
        own = described(rows.groupBy("node", "outcome").agg(F.count("*").alias("n")), ["node"])
        own = own.select("node", F.lit(depth).alias("depth"), F.col("n").alias("cases"), F.col("kinds").alias("outcome_kinds"), F.round(F.col("bits") + 1, 6).alias("leaf_bits"))
        split = best_splits(rows, numeric, ["node"]) if depth < len(numeric) + len(categorical) else rows.sparkSession.createDataFrame([], "node string, field string, cut double, candidates long, bits double")
        level = own.join(split, "node", "left")
        better = F.coalesce((F.col("bits") < F.col("leaf_bits")) & (F.col("cases") > 1) & (F.col("outcome_kinds") > 1), F.lit(False))
        kept = {c: F.when(better, F.col(c)) for c in ("field", "cut", "candidates")}
        level = checkpointed(level.select("node", "depth", "cases", "outcome_kinds", "leaf_bits", *[v.alias(k) for k, v in kept.items()], F.when(better, F.col("bits")).alias("split_bits")))
        nodes = level if nodes is None else nodes.unionByName(level)
        chosen = level.where("field IS NOT NULL").select("node", "field", "cut")
        n = chosen.count()
        if not n:
            return nodes
        met = rows.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, "node")
        v = F.element_at("values", F.col("field"))
        number = F.when(v["x"] <= F.col("cut"), F.concat(F.lit("<="), F.col("cut").cast("string"))).when(v["x"] > F.col("cut"), F.concat(F.lit(">"), F.col("cut").cast("string")))
        branch = F.coalesce(number, F.concat(F.lit("="), v["text"]), F.lit(f"={MISSING}"))
        rows = checkpointed(met.select(F.concat("node", F.lit("/"), "field", branch).alias("node"), "outcome", F.array_remove("left", F.col("field")).alias("left"), "values"))
        depth += 1


def first_splits(cases: DataFrame, outcome: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(field, cut, candidates, bits): the best split of all cases by each field."""
    return best_splits(checkpointed(open_cases(cases, outcome, numeric, categorical)), numeric, ["node", "field"]).drop("node")
