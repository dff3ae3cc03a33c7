"""Query op8_langid: language of all documents, learned on two thirds of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import default_vocabulary, predict, train


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    learn = docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", "lang")
    found = predict(docs, train(learn, default_vocabulary()))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_langid": op8_langid}
#: A trained model has no SQL form; tests/llm measures held-out accuracy and compares the sums with brute force.
ORACLES: dict[str, str] = {}
