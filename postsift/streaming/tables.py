"""Batch-numbered tables that a retried micro-batch overwrites instead of doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one micro-batch, in a folder of their own that a retry replaces."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch_id={batch_id}")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def read_before(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of all earlier micro-batches; a retry sees neither its own nor later ones."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(path).where(
        F.col("batch_id") < batch_id
    ).drop("batch_id")


def snapshot_before(spark: SparkSession, path: str, batch_id: int, first: DataFrame) -> DataFrame:
    """The table as it was before this micro-batch: ``first`` before the first one.

    Every micro-batch writes a snapshot, so the one before has the number before. A retry
    starts from the same snapshot again, which makes the update exactly-once.
    """
    if batch_id == 0:
        return first
    return read_batch(spark, path, batch_id - 1).select(*first.columns)
