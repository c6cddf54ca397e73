"""Tumbling flush windows as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.queue import tick_end, tick_of
from .tables import read_all, read_before, write_batch


def count_flushes(path: str) -> Callable[[DataFrame, int], None]:
    """Count the queue rows ``(priority, received_at)`` of each micro-batch per flush.

    One read serves all four schedules, and no row is dropped for being late: a row that
    comes when its flush is over, by the latest arrival of earlier micro-batches, goes with
    the first flush that is not, and counts in ``n_late``. Each micro-batch writes its own
    sums, one row per priority and flush, which ``flush_counts`` adds up.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        clock = f"{path}/clock"
        before = read_before(batch.sparkSession, clock, batch_id, "at bigint")
        now = before.agg(F.max("at")).first()[0]
        write_batch(batch.agg(F.max("received_at").alias("at")), clock, batch_id)

        due = _flush_after(F.col("received_at"))
        late = F.lit(False) if now is None else due <= now
        sent = F.when(late, _flush_after(F.lit(now).cast("bigint"))).otherwise(due)
        counts = (
            batch.select("priority", sent.alias("flush_at"), late.alias("late"))
            .where("flush_at IS NOT NULL")
            .groupBy("priority", "flush_at")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"))
        )
        write_batch(counts, f"{path}/counts", batch_id)

    return run


def _flush_after(at):
    return tick_end(F.col("priority"), tick_of(F.col("priority"), at))


def flush_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(priority, flush_at, n, n_late)`` over all micro-batches, open flushes included."""
    return (
        read_all(spark, f"{path}/counts")
        .groupBy("priority", "flush_at")
        .agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))
    )
