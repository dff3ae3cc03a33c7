"""Query op2_secrets: secrets in all documents, by patterns and by character models."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_scan import labelled_samples, listed, scan, train


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


QUERIES = {"op2_secrets": op2_secrets}
#: The trained models have no SQL form; tests/llm compares with a brute-force version.
ORACLES: dict[str, str] = {}
