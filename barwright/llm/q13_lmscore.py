"""Query op13_lmscore: log-probability of all documents under a model learned on nine tenths of them."""

from pyspark.sql import DataFrame, SparkSession

from .lmscore import score_documents


def op13_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs.select("doc_id", "text"))


QUERIES = {"op13_lmscore": op13_lmscore}
#: A trained mixer has no SQL form; tests/llm compares with a bit-by-bit version and the base with brute force.
ORACLES: dict[str, str] = {}
