"""Query op6_idstore: all documents as id shards, read back through their perfect hash index."""

from pyspark.sql import DataFrame, SparkSession

from .idstore import token_store
from .tokens import default_tokenizer


def op6_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_store(docs, default_tokenizer(), end_id=0)


QUERIES = {"op6_idstore": op6_idstore}
#: Tokenizing has no SQL form; tests/llm compares with the tokenizer itself.
ORACLES: dict[str, str] = {}
