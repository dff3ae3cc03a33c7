"""Raw pages to rows: HTML tables, JSON bodies, states embedded in pages, text reports, and the clocks they are stamped with.

Everything is an expression over a body column but for balanced braces, which need a small pandas function.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW, CELL = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def text_of(html: Column) -> Column:
    """Text of a fragment: tags away, the common entities back, white space run together."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def number(text: Column) -> Column:
    """A number with thousands separators; null for placeholders such as ``-`` and ``N/A``."""
    return F.regexp_replace(text, r"[,\s%]", "").try_cast("double")


def table_rows(html: Column) -> Column:
    """array<array<string>>: cells of all table rows of a page, rows without cells left out."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(ROW), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), text_of))
    return F.filter(rows, lambda r: F.size(r) > 0)


def named_table(pages: DataFrame, body: str, names: Mapping[str, str]) -> DataFrame:
    """Rows of the pages' tables by header: ``names`` maps header texts (case does not count) to output columns.

    The first row that has one of the headers is the header row; rows of other widths are left out. Other columns stay.
    """
    others = [c for c in pages.columns if c != body]
    heads = F.array(*[F.lit(n.lower()) for n in names])
    rows = pages.withColumn("_rows", table_rows(F.col(body)))
    head = F.filter("_rows", lambda r: F.exists(r, lambda c: F.array_contains(heads, F.lower(c))))[0]
    found = rows.withColumn("_head", F.transform(F.try_element_at(F.array(head), F.lit(1)), lambda c: F.lower(c)))
    lines = found.select(*others, "_head", F.posexplode("_rows").alias("row", "_cells")).where(F.size("_cells") == F.size("_head"))
    lines = lines.where(F.transform("_cells", lambda c: F.lower(c)) != F.col("_head"))
    return lines.select(*others, "row", *[F.get("_cells", (F.array_position("_head", n.lower()) - 1).cast("int")).alias(c) for n, c in names.items()])


def depth_levels(html: Column) -> Column:
    """array<struct<price, qty>> of a table of price and quantity cells; headers and levels without quantity left out."""
    rows = F.transform(table_rows(html), lambda r: F.struct(number(F.get(r, F.lit(0))).alias("price"), number(F.get(r, F.lit(1))).alias("qty")))
    return F.filter(rows, lambda x: x["price"].isNotNull() & (x["qty"] > 0))


def json_rows(pages: DataFrame, body: str, schema: str, path: str | None = None) -> DataFrame:
    """Rows of JSON bodies that hold an array of objects, or one in the field ``path``; only fields of ``schema`` are read.

    Bodies that are no JSON have no rows. Adds ``row``, the place in the array.
    """
    others = [c for c in pages.columns if c != body]
    own = F.from_json(body, f"array<struct<{schema}>>") if path is None else F.from_json(body, f"{path} array<struct<{schema}>>")[path]
    lines = pages.select(*others, F.posexplode(own).alias("row", "_x"))
    return lines.select(*others, "row", "_x.*")


def embedded_json(marker: str):
    """Function of a text column: the JSON object that follows ``marker`` in a page, found by matching braces outside strings."""

    @F.pandas_udf("string")
    def find(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(html: str | None) -> str | None:
            at = (html or "").find(marker)
            start = (html or "").find("{", at + len(marker)) if at >= 0 else -1
            depth, quoted, skip = 0, False, False
            for i in range(max(start, 0), len(html or "") if start >= 0 else 0):
                c = html[i]
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        return html[start : i + 1]
            return None

        for batch in pages:
            yield batch.map(one)

    return find


#: What sources write for no value (fixed values).
PLACEHOLDERS = ["", "-", "--", "n/a", "na", "null", "none", "nan"]


def hollow(values: Column) -> Column:
    """Whether an array of strings holds nothing but placeholders; a null array is hollow."""
    return F.coalesce(F.forall(values, lambda v: F.coalesce(F.lower(F.trim(v)), F.lit("")).isin(PLACEHOLDERS)), F.lit(True))


def dotnet_time(text: Column) -> Column:
    """Timestamp of an ISO string with up to seven fraction digits; the seventh is dropped."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")).cast("timestamp_ntz")


def zone_candidates(text: Column, zone: str) -> Column:
    """struct<as_utc, as_local>: a stamp read as universal time, and as local time of ``zone`` turned into it."""
    t = dotnet_time(text)
    local = F.to_utc_timestamp(t.cast("timestamp"), zone).cast("timestamp_ntz")
    return F.struct(t.alias("as_utc"), local.alias("as_local"))


def report_totals(text: Column, names: Mapping[str, str]) -> Column:
    """struct of the numbers behind labels of a plain-text report, one ``label : number`` a line."""
    quote = lambda label: "".join("\\" + c if not c.isalnum() and c != " " else c for c in label)
    return F.struct(*[number(F.regexp_extract(text, rf"(?im)^\s*{quote(label)}\s*[:.]*\s*([-0-9,.]+)", 1)).alias(c) for label, c in names.items()])


def load_states(spark: SparkSession, path: str, mechanisms: list[str]) -> DataFrame:
    """JSON lines of states as a flat table; the map of mechanisms becomes columns ``mech_<name>_score`` and ``_phase``."""
    schema = "symbol string, t timestamp, mid double, mechanisms map<string, struct<score: double, phase: string>>"
    s = spark.read.schema(schema).json(path)
    return s.select("symbol", "t", "mid", *[F.try_element_at("mechanisms", F.lit(m))[f].alias(f"mech_{m}_{f}") for m in mechanisms for f in ("score", "phase")])


def load_series(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of files that hold one JSON array each, rows marked as gaps left out."""
    return spark.read.schema("symbol string, t timestamp, value double, gap boolean").option("multiLine", True).json(pattern).where("NOT coalesce(gap, false)").drop("gap")


def claims(tables: Mapping[str, DataFrame], key: str, attributes: list[str]) -> DataFrame:
    """(source, key, attribute, value): what each source says of each key; nulls and placeholders claim nothing."""
    out = None
    for source, df in tables.items():
        have = [a for a in attributes if a in df.columns]
        own = df.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in have])).alias("c")).select("source", "key", "c.*")
        out = own if out is None else out.unionByName(own)
    return out.where(F.col("value").isNotNull() & ~F.lower(F.trim("value")).isin(PLACEHOLDERS))


def spine(claimed: DataFrame) -> DataFrame:
    """(key, attribute, value, status, sources): one claimed value is OBSERVED, several are withheld as a CONFLICT."""
    g = claimed.groupBy("key", "attribute").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("source").alias("sources"))
    same = F.col("lo") == F.col("hi")
    return g.select("key", "attribute", F.when(same, F.col("lo")).alias("value"), F.when(same, "OBSERVED").otherwise("CONFLICT").alias("status"), "sources")
