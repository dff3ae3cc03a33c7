"""Query op10_packing: all documents packed into sequences of 1024 tokens."""

from pyspark.sql import DataFrame, SparkSession

from .packing import pack
from .tokens import default_tokenizer


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, default_tokenizer(), end_id=2, capacity=1024)


QUERIES = {"op10_packing": op10_packing}
#: Tokenizing and packing have no SQL form; tests/llm compares with the tokenizer and checks every sequence.
ORACLES: dict[str, str] = {}
