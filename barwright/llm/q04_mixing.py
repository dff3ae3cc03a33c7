"""Query op4_mixing: all documents mixed to source weights 5, 2, 1 with at most three epochs."""

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_mixing": op4_mixing}
#: The seeded draw has no SQL form; tests/llm compares targets with a brute-force version and checks the sample.
ORACLES: dict[str, str] = {}
