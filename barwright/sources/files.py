"""Bars from CSV files and tables into files: coercion, required columns, symbols from file names, guarded sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a bar file and their types; the first two are keys.
BAR_COLUMNS = {"symbol": "string", "ts": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double"}
REQUIRED = ("symbol", "ts", "close")


def read_bars_csv(spark: SparkSession, path: str | Sequence[str], names: Mapping[str, str] | None = None, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Bars of CSV files with a header: known columns, coerced; what cannot be read is null.

    ``names`` maps a file's column names to those here; case and space around names do not count. Missing required
    columns are an error, other missing ones null. Rows without a key are left out, and columns of no use are not read.
    """
    raw = spark.read.csv(path, header=True)
    found = {c.strip().lower(): c for c in raw.columns}
    own = {n: found.get(n) for n in BAR_COLUMNS} | {n: found[c.strip().lower()] for c, n in (names or {}).items() if c.strip().lower() in found}
    lacking = [n for n in required if own.get(n) is None]
    if lacking:
        raise ValueError(f"{path}: no column for {lacking}")
    plain = lambda c: F.trim(F.col("`" + c.replace("`", "``") + "`"))
    cast = lambda c, kind: F.regexp_replace(plain(c), ",", "").try_cast(kind) if kind == "double" else plain(c).try_cast(kind)
    out = raw.select(*[(cast(own[n], k) if own.get(n) else F.lit(None).cast(k)).alias(n) for n, k in BAR_COLUMNS.items()])
    return out.where("symbol IS NOT NULL AND ts IS NOT NULL")


def read_symbol_folder(spark: SparkSession, folder: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """Bars of a folder with one CSV file a symbol, named after it; any symbol column in the files is ignored."""
    raw = spark.read.csv(f"{folder}/*.csv", header=True)
    symbol = F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    own = {n: c for c, n in (names or {}).items()}
    pick = lambda n: F.trim(F.col("`" + own.get(n, n) + "`"))
    have = {c.lower() for c in raw.columns}
    out = [symbol.alias("symbol")]
    for n, kind in BAR_COLUMNS.items():
        if n != "symbol":
            out.append((pick(n).try_cast(kind) if own.get(n, n).lower() in have else F.lit(None).cast(kind)).alias(n))
    return raw.select(*out).where("ts IS NOT NULL")


def minute_panel(minutes: DataFrame) -> DataFrame:
    """Daily bars of minute rows (symbol, t, open, high, low, close, volume), with the first and last minute of each day."""
    at = F.struct("t", "open", "close")
    g = minutes.where("symbol IS NOT NULL AND t IS NOT NULL").groupBy("symbol", F.to_date("t").alias("ts")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.count("*").alias("minutes")
    )
    return g.select("symbol", "ts", F.col("first.open").alias("open"), "high", "low", F.col("last.close").alias("close"), "volume", "minutes", F.col("first.t").alias("first_minute"), F.col("last.t").alias("last_minute"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write ``df`` over what stands at ``path`` unless it is empty; says whether it wrote. CSV holds nested columns as JSON."""
    if df.isEmpty():
        return False
    if fmt == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        df = df.select(*[(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name) for f in df.schema.fields])
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return True


def extract(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Every table as CSV below ``folder``, and the coverage: (table, n_rows, n_columns, written)."""
    rows = [(name, df.count(), len(df.columns), write_table(df, f"{folder}/{name}", "csv")) for name, df in tables.items()]
    return spark.createDataFrame(rows, "table string, n_rows long, n_columns int, written boolean")
