"""Query op9_ann: the ten nearest embeddings of every hundredth one."""

from pyspark.sql import DataFrame, SparkSession

from .ann import neighbours


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100)


QUERIES = {"op9_ann": op9_ann}
#: The search is approximate; tests/llm measures its recall against brute force and checks scores exactly.
ORACLES: dict[str, str] = {}
