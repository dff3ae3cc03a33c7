"""Query op3_simhash: near-duplicate classes of documents by 4-word SimHash within 4 bits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simhash import near_classes


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_classes(docs, words=4, threshold=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
#: XXH64 and majority bits have no SQL form; tests/llm compares with a brute-force version.
ORACLES: dict[str, str] = {}
