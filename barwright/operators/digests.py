"""Digests of tables that depend on the order of rows and on nothing else: not on partitions, column order or how doubles print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import sums_before

#: Digests that one digest of the next level is taken of.
FAN = 1024


def quoted(text: Column) -> Column:
    """A JSON string."""
    escaped = text
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def canonical(value: Column, kind: T.DataType) -> Column:
    """``value`` as JSON text that equal values share: keys in order, no spaces, nulls kept, whole doubles as whole numbers, no NaN.

    Structs and maps become objects with sorted keys, dates and times strings.
    """
    comma = lambda parts: F.array_join(parts, ",")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        text = F.concat(F.lit("{"), comma(F.array(*[F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value.getField(f.name), f.dataType)) for f in fields])), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), comma(F.transform(value, lambda x: canonical(x, kind.elementType))), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), comma(F.transform(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), entry)), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        double = value.cast("double")
        whole = (F.abs(double) < 1e15) & (F.floor(double) == double)
        text = F.when(F.isnan(double), F.lit("null")).when(whole, F.floor(double).cast("string")).otherwise(double.cast("string"))
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        text = value.cast("string")
    else:
        text = quoted(value.cast("string"))
    return F.coalesce(text, F.lit("null"))


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """The named columns of a row as one canonical object."""
    return canonical(F.struct(*columns), df.select(F.struct(*columns).alias("r")).schema["r"].dataType)


def ordered_digest(df: DataFrame, by: list[str], order: str, columns: list[str], levels: int | None = None) -> DataFrame:
    """(by, n, digest): the SHA-256 of each group's rows in ``order`` (a number, unique within the group).

    A Merkle list: rows are numbered in ranges, every FAN digests in order make one of the next level, until one is left. No
    task holds more than FAN digests of a group at a time, and a group's digest has as many levels as its own size needs.
    With ``levels`` there are at most so many, and the last makes one digest of all that are left: of a group of n rows, a
    task then holds n / FAN ** (levels - 1) digests.
    """
    rows = df.select(*by, F.col(order).alias("at"), F.sha2(row_text(df, columns), 256).alias("digest"), F.lit(1).alias("one"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    most, done, depth = sizes.agg(F.max("n")).first()[0] or 0, 1, 0
    level = sums_before(rows, "at", {"number": "one"}, by).select(*by, F.col("number").cast("long").alias("number"), "digest").join(sizes, by)
    while done == 1 or done < most:
        depth += 1
        fan = most if depth == levels else FAN
        parts = level.withColumn("of", F.floor(F.col("number") / fan)).groupBy(*by, "n", "of").agg(F.sort_array(F.collect_list(F.struct("number", "digest"))).alias("d"))
        joined = F.sha2(F.array_join(F.transform("d", lambda x: x["digest"]), ""), 256)
        # One digest that is all of its group already stays as it is.
        digest = joined if done == 1 else F.when(F.col("n") <= done, F.col("d")[0]["digest"]).otherwise(joined)
        level, done = parts.select(*by, "n", F.col("of").alias("number"), digest.alias("digest")), done * fan
    return level.select(*by, "n", "digest")


def prefix_duplicates(lines: DataFrame, file: str, position: str, columns: list[str]) -> DataFrame:
    """(file, n, same_as, prefix_of) of files whose lines are those of another, or those another begins with.

    ``position`` numbers a file's lines from 0. ``same_as`` is the smallest file of the same lines if that is another one,
    ``prefix_of`` the smallest longer file that begins with them; files with neither are left out.

    A line's two 64-bit hashes depend on its position, so sums over a file's first lines digest that beginning; they are running
    sums in ranges. Only beginnings as long as some file is are kept, a row of the table at most, and a file's whole digest meets
    them by equality: no pairs of files are compared, and groups of equal files meet as one.
    """
    text = row_text(lines, columns)
    hashes = {f"h{i}": F.xxhash64(text, F.col(position), F.lit(i)).cast("decimal(20,0)") for i in (0, 1)}
    hashed = lines.select(F.col(file).alias("file"), F.col(position).cast("long").alias("at"), *[h.alias(n) for n, h in hashes.items()])
    run = sums_before(hashed, "at", {"before0": "h0", "before1": "h1"}, ["file"])
    starts = run.select("file", (F.col("at") + 1).alias("n"), *[(F.col(f"before{i}") + F.col(f"h{i}")).cast("decimal(38,0)").alias(f"d{i}") for i in (0, 1)])
    lengths = hashed.groupBy("file").agg(F.count("*").alias("n"))
    wholes = starts.join(lengths, ["file", "n"]).groupBy("n", "d0", "d1").agg(F.min("file").alias("first"))
    whole = starts.join(lengths, ["file", "n"]).join(wholes, ["n", "d0", "d1"])
    sized = lengths.select("n").distinct()
    begun = starts.join(sized, "n").join(lengths.select("file", F.col("n").alias("length")), "file").where("n < length")
    longer = begun.groupBy("n", "d0", "d1").agg(F.min("file").alias("prefix_of"))
    found = whole.join(longer, ["n", "d0", "d1"], "left").withColumn("same_as", F.when(F.col("first") != F.col("file"), F.col("first")))
    return found.where("same_as IS NOT NULL OR prefix_of IS NOT NULL").select("file", "n", "same_as", "prefix_of")
