"""Counts and recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY_MS, utc_day_key, utc_month_start
from ..functions.priorities import QUEUED
from .queue import unsent

RECENT_PENDING = 30
RECENT_PROCESSED = 30
RECENT_HISTORY = 10


def processed_counts(processed: DataFrame, now_ms: int) -> DataFrame:
    """``(processed_today, processed_month)`` in one pass: last 24 h, and since month start."""
    now = F.lit(now_ms).cast("bigint")
    at = F.col("processed_at")
    return processed.agg(
        F.count_if(at > now - F.lit(DAY_MS)).alias("processed_today"),
        F.count_if(at > utc_month_start(now)).alias("processed_month"),
    )


def pending_counts(pending: DataFrame) -> DataFrame:
    """Unsent rows per priority: the four queues even at zero, others if they occur."""
    return with_all_queues(unsent(pending).groupBy("priority").agg(F.count(F.lit(1)).alias("n")))


def with_all_queues(counted: DataFrame) -> DataFrame:
    """Counts ``(priority, n)`` with a row for each of the four queues."""
    spark = counted.sparkSession
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, QUEUED))).alias("priority"))
    return fixed.join(counted, "priority", "full").select(
        "priority", F.coalesce("n", F.lit(0)).alias("n")
    )


def is_daily_call() -> Column:
    return F.col("method").isin("openrouter", "workers-ai")


def daily_classifications(results: DataFrame) -> DataFrame:
    """Successful scored calls per UTC day; ``results(ts, method)``."""
    return (
        results.where(is_daily_call())
        .groupBy(utc_day_key(F.col("ts")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def newest(df: DataFrame, by: str, tie: str, limit: int) -> DataFrame:
    """Latest rows (``TakeOrderedAndProject``: each task keeps at most ``limit``)."""
    return df.orderBy(F.col(by).desc(), tie).limit(limit)


def recent_pending(pending: DataFrame) -> DataFrame:
    columns = pending.select("id", "from_addr", "subject", "priority", "received_at", "sent_at")
    return newest(columns, "received_at", "id", RECENT_PENDING)


def recent_processed(processed: DataFrame) -> DataFrame:
    return newest(processed, "processed_at", "message_id", RECENT_PROCESSED)


def recent_history(history: DataFrame) -> DataFrame:
    return newest(history, "processed_at", "history_id", RECENT_HISTORY)
