"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# UTC for anything that prints a timestamp; AQE chooses join sides from measured sizes and
# splits skewed join partitions; Arrow batches are bounded in bytes, because a row may hold
# a megabyte of attachment. Rank filters up to that threshold are also applied before the
# shuffle (the default of 1,000 would leave a large quota or flush cap to one task). Base64
# comes without line breaks, which would only be taken out again.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.chunkBase64String.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"postsift-{application}-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster
    a machine-local folder would vanish with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/postsift/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where a later step must see the very same rows again (partition numbers,
    state handed from one pass to the next): a lost executor then rereads files
    instead of recomputing a differently sampled shuffle.
    """
    return stage_at(df, scratch_path(df.sparkSession, name))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """``stage`` with the folder chosen by the caller, who may ``remove`` it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder, in whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted now.

    Spark deletes them once the driver's collector finds their plans unused, which may take as
    long as the job; between steps that each shuffle the whole input that would add them up.
    """
    gc.collect()
    spark._jvm.System.gc()
