"""The corpus pipeline: documents through quality rules, near-duplicates, secrets, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. Every stage takes nulls in any column, repeated rows and further columns of any name; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm.common import materialise
from barwright.llm.mixing import repeat_documents
from barwright.llm.nearcopies import drop_near_copies
from barwright.llm.packing import pack
from barwright.llm.quality import keep_documents
from barwright.llm.secret_scan import labelled_samples, redact, train
from barwright.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a certified cutoff rejects; null and empty texts fail the base rule.

    Repeated rows are judged alike and all stay or go.
    """
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    SimHash components at 4 bits first, then an exact join of what is left. Null texts and texts without words are one
    group; equal rows are one row.
    """
    return drop_near_copies(docs, words=5, threshold=4, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark; null texts stay null, repeated rows stay repeated."""
    return redact(docs, train(labelled_samples(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, null texts have size 0."""
    return repeat_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; a null text is a piece of its end id alone."""
    return pack(docs, default_tokenizer(), end_id=2, capacity=1024)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Trained models, fingerprints, seeded draws and tokenizing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
