"""Wire formats made from the tables and parsed back: what comes out must be what went in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import wire
from ..sources.tables import TAPE, table, tape
from .registry import query


@query(f"WITH {TAPE} SELECT event_id, 'W' AS kind, symbol, value AS price, k AS qty, event_id % 10 <> 0 AS checksum_ok FROM tape")
def fix_messages(spark, sf_dir):
    """Prints as FIX messages, parsed with their checksum verified; every tenth one is damaged on the way."""
    t = tape(spark, sf_dir)
    body = F.concat(F.lit(f"8=FIX.4.4{wire.SOH}35=W{wire.SOH}55="), F.col("symbol"), F.lit(f"{wire.SOH}270="), F.col("value").cast("string"), F.lit(f"{wire.SOH}271="), F.col("k"), F.lit(wire.SOH))
    sent = t.select("event_id", body.alias("body")).withColumn("raw", F.concat("body", F.lit("10="), F.lpad(((wire.checksum(F.col("body")) + (F.col("event_id") % 10 == 0).cast("int")) % 256).cast("string"), 3, "0"), F.lit(wire.SOH)))
    got = sent.select("event_id", "raw", wire.parse_fix(F.col("raw")).alias("m"), F.regexp_replace("raw", "10=[0-9]{3}\x01$", "").alias("signed"))
    return got.select("event_id", F.col("m")["35"].alias("kind"), F.col("m")["55"].cast("long").alias("symbol"), F.col("m")["270"].cast("double").alias("price"), F.col("m")["271"].cast("int").alias("qty"), (F.col("m")["10"].cast("int") == wire.checksum(F.col("signed"))).alias("checksum_ok"))


@query(f"WITH {TAPE} SELECT event_id, symbol AS stream, symbol, k, value FROM tape")
def binary_frames(spark, sf_dir):
    """Prints as length-prefixed binary streams per symbol and day, read back frame by frame."""
    t = tape(spark, sf_dir).select("event_id", "symbol", "k", "value", F.to_date("t").alias("day"))
    frames = wire.read_frames(wire.write_frames(t, "symbol", "event_id"))
    return frames.where("rest IS NULL").select("event_id", "stream", "symbol", "k", "value")


@query(f"WITH {TAPE} SELECT event_id AS seq, source, event_id % 7 <> 0 AS sha_ok, true AS crc_ok, coalesce(event_id - lag(event_id) OVER (PARTITION BY source ORDER BY event_id) > 5, false) AS hole FROM tape")
def raw_records(spark, sf_dir):
    """Raw JSON records with base64 bodies: decoded, both checksums verified, holes in the sequence marked."""
    t = tape(spark, sf_dir)
    body = F.encode(F.to_json(F.struct("symbol", "value", "k")), "UTF-8")
    sha = F.when(F.col("event_id") % 7 == 0, F.lit("0")).otherwise(F.sha2(body, 256))
    line = F.to_json(F.struct(F.col("event_id").alias("seq"), "source", F.base64(body).alias("body"), sha.alias("sha"), F.crc32(body).alias("crc")))
    rec = t.select(F.from_json(line, "seq LONG, source STRING, body STRING, sha STRING, crc LONG").alias("r")).select("r.*")
    raw = F.unbase64("body")
    hole = F.col("seq") - F.lag("seq").over(Window.partitionBy("source").orderBy("seq")) > 5
    return rec.select("seq", "source", (F.sha2(raw, 256) == F.col("sha")).alias("sha_ok"), (F.crc32(raw) == F.col("crc")).alias("crc_ok"), F.coalesce(hole, F.lit(False)).alias("hole"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS qty, CASE WHEN l_discount < 0.05 THEN NULL ELSE l_tax END AS fee FROM lineitem")
def broker_export(spark, sf_dir):
    """Line items as CSV lines with dashes for missing numbers, parsed by schema and coerced."""
    x = table(spark, sf_dir, "lineitem")
    fee = F.when(F.col("l_discount") < 0.05, F.lit("--")).otherwise(F.col("l_tax").cast("string"))
    line = F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", fee)
    r = x.select(F.from_csv(line, F.lit("Order LONG, Line INT, Part LONG, Qty STRING, Fee STRING")).alias("r")).select("r.*")
    num = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    return r.select(F.col("Order").alias("l_orderkey"), F.col("Line").alias("l_linenumber"), F.col("Part").alias("l_partkey"), num("Qty").alias("qty"), num("Fee").alias("fee"))


@query(f"WITH {TAPE} SELECT symbol, event_id, value, (row_number() OVER (PARTITION BY symbol, CAST(t AS DATE) ORDER BY event_id) - 1)::INT AS row_index FROM tape")
def json_tape_pages(spark, sf_dir):
    """Prints as one JSON page per symbol and day, exploded again with their place on the page."""
    t = tape(spark, sf_dir)
    rows = F.sort_array(F.collect_list(F.struct("event_id", "value")))  # bounded by a symbol's day
    pages = t.groupBy("symbol", F.to_date("t").alias("day")).agg(F.to_json(rows).alias("page"))
    out = pages.select("symbol", F.posexplode(F.from_json("page", "ARRAY<STRUCT<event_id: LONG, value: DOUBLE>>")).alias("row_index", "r"))
    return out.select("symbol", F.col("r.event_id").alias("event_id"), F.col("r.value").alias("value"), "row_index")
