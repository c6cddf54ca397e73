"""Keyed latest-value table ``(key, value, updated_at)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.feed import history_number
from .queue import insert_ignore


def latest(changes: DataFrame, key: str = "key", rank: str = "updated_at") -> DataFrame:
    """One row per key: the one with the highest ``rank``, partly aggregated before its shuffle."""
    others = [c for c in changes.columns if c not in (key, rank)]
    best = changes.groupBy(key).agg(F.max(F.struct(rank, *others)).alias("_best"))
    return best.select(key, "_best.*").select(*changes.columns)


def upsert(state: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """Last write per key wins, by ``updated_at``; a change beats an old row of equal time.

    Of changes with equal times the greater number wins, so a cursor never moves back.
    """
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    number = history_number(F.col("value")).alias("number")
    ranked = both.withColumn("_rank", F.struct("updated_at", "_new", number)).drop("_new")
    return latest(ranked, key, "_rank").drop("_rank")


def insert_absent(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Set only keys that have no value yet (first cursor of a newly watched account)."""
    return insert_ignore(state, changes, "key", ["updated_at", "value"])


def lookup(keys: DataFrame, state: DataFrame) -> DataFrame:
    """``(key, value)`` for each asked key; the value is NULL where there is none."""
    return keys.join(state.select("key", "value"), "key", "left")


CURSOR_PREFIX = "gmail:history_id:"


def cursors(state: DataFrame) -> DataFrame:
    """``(account, cursor)`` from the state table."""
    return state.where(F.startswith("key", F.lit(CURSOR_PREFIX))).select(
        F.expr(f"substring(key, {len(CURSOR_PREFIX) + 1})").alias("account"),
        F.nullif(F.col("value"), F.lit("")).alias("cursor"),
    )


def cursor_changes(next_cursors: DataFrame, now_ms: int) -> DataFrame:
    """State rows for new cursors ``(account, cursor)``."""
    return next_cursors.select(
        F.concat(F.lit(CURSOR_PREFIX), F.col("account")).alias("key"),
        F.col("cursor").alias("value"),
        F.lit(now_ms).cast("bigint").alias("updated_at"),
    )
