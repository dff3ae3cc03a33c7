"""The folder all executors see, and lineage cut there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset (tests on one machine), a temporary folder for the whole session."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        current = sc._jsc.sc().getCheckpointDir()
    return (spark.conf.get("spark.checkpoint.dir", None) or current.get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as Parquet in the shared folder, a fraction of a checkpoint's size, as long as the block runs."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    try:
        df.write.parquet(name)
        yield spark.read.parquet(name)
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
