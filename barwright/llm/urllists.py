"""URL lists over time: dated entries become validity intervals, captures are judged by those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Length of the time buckets that intervals and captures meet in, in days.
BUCKET_DAYS = 30


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"(:[0-9]*)?\.?$", ""))


def bare_url(url: Column) -> Column:
    """The URL without fragment."""
    return F.regexp_replace(url, "#.*$", "")


def keys_of(url: Column) -> Column:
    """array<struct<kind, key, rank>>: what entries may name for a URL, the most specific first.

    The URL itself, its host, and the host's parent domains down to two labels.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: i <= n - 2),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i + 1, F.greatest(n - i, F.lit(0))), ".").alias("key"), (i + 2).alias("rank")),
    )
    first = F.array(
        F.struct(F.lit("url").alias("kind"), bare_url(url).alias("key"), F.lit(0).alias("rank")),
        F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(1).alias("rank")),
    )
    none = F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, key: STRING, rank: INT>>)")
    return F.when(url.isNull(), none).when(host == "", F.slice(first, 1, 1)).otherwise(F.concat(first, parents))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, verdict, valid_from, valid_to) of entries (kind, key, day date, action).

    An entry holds from its day until the key's next entry; ``remove`` ends the one before and holds nothing. Of several
    on one day the last in the order block, allow, remove counts. An interval without an end has a null ``valid_to``.
    Entries with a null in any column are left out.
    """
    order = F.expr("CASE action WHEN 'remove' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END")
    fine = entries.select("kind", "key", "day", "action").dropna()
    daily = fine.groupBy("kind", "key", "day").agg(F.max_by("action", order).alias("verdict"))
    w = Window.partitionBy("kind", "key").orderBy("day")  # a list key's own changes; copies of an entry are gone here
    spans = daily.withColumn("valid_to", F.lead("day").over(w)).withColumnRenamed("day", "valid_from")
    return spans.where("verdict <> 'remove'").select("kind", "key", "verdict", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(capture, fetched, verdict, matched_kind, matched_key, valid_from) for each row of ``captures``.

    ``captures``: (capture, url, fetched date). The most specific entry active on the day decides: URL, host, then
    parent domains from the longest; without one, and where url or day is null, the verdict is ``allow`` and what
    matched is null. Repeated captures are judged each; either table may be empty, and other columns may have any names.

    Captures and interval starts of a list key meet in buckets of ``bucket_days``. A bucket also takes in the interval that is
    last to start before it, which is the only older one that can reach into it: a row for each key and bucket with captures, however far
    apart days lie. So the join is an equi-join on (kind, key, bucket), its rows are the starts of captured keys and one more
    for each captured bucket, and a hot host spreads over buckets. List keys that no capture names are left out.
    """
    row = captures.select("capture", "url", "fetched").withColumn("row_", F.monotonically_increasing_id())
    row = materialise(row, "captures")
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / bucket_days)
    named = row.where("fetched IS NOT NULL").select("row_", "fetched", F.inline(keys_of(F.col("url")))).withColumn("bucket", bucket(F.col("fetched")))
    asked = materialise(named.select("kind", "key", "bucket").distinct(), "asked")
    spans = intervals(entries).withColumn("span", F.struct("valid_from", "valid_to", "verdict")).select("kind", "key", bucket(F.col("valid_from")).alias("bucket"), "span")
    spans = materialise(spans.join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi"), "intervals")
    # Per key and bucket the last start, carried on to the captured buckets after it.
    last = spans.groupBy("kind", "key", "bucket").agg(F.max("span").alias("own")).unionByName(asked, allowMissingColumns=True)
    last = last.groupBy("kind", "key", "bucket").agg(F.max("own").alias("own"), F.max(F.col("own").isNull()).alias("asked"))
    before = Window.partitionBy("kind", "key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("span", F.last("own", True).over(before)).where("asked AND span IS NOT NULL").select("kind", "key", "bucket", "span")
    active = named.join(spans.unionByName(carried), ["kind", "key", "bucket"]).where("span.valid_from <= fetched AND (span.valid_to IS NULL OR fetched < span.valid_to)")
    best = active.groupBy("row_").agg(F.min_by(F.struct("span.verdict", "kind", "key", "span.valid_from"), "rank").alias("m"))
    out = row.join(best, "row_", "left")
    return out.select(
        "capture", "fetched", F.coalesce("m.verdict", F.lit("allow")).alias("verdict"), F.col("m.kind").alias("matched_kind"),
        F.col("m.key").alias("matched_key"), F.col("m.valid_from").alias("valid_from"),
    )
