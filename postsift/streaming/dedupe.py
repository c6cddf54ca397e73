"""Duplicates of notifications and messages, forgotten after 48 hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how long a seen notification or message is remembered.
MEMORY = "48 hours"


def first_seen(
    stream: DataFrame, keys: list[str], memory: str = MEMORY, spread: int = 1
) -> DataFrame:
    """Drop rows whose ``keys`` were seen within ``memory``; every other row passes.

    Memory counts from when a row is processed, as in what has to be matched, and not from
    a time the row states: the watermark then never runs ahead of a row, so a row is never
    dropped for being late, however old it is.

    ``spread > 1`` is for keys with very many copies: copies are first dropped within
    ``spread`` shares of the input's partitions, each on a task of its own, so that the one
    task that holds the key sees at most ``spread`` of them per micro-batch. Shares go by
    partition and not by content, since copies may be equal in every column.
    """
    marked = stream.withColumn("_processed_at", F.current_timestamp()).withWatermark(
        "_processed_at", memory
    )
    if spread > 1:
        marked = (
            marked.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(spread)))
            .dropDuplicatesWithinWatermark([*keys, "_share"])
            .drop("_share")
        )
    return marked.dropDuplicatesWithinWatermark(keys).drop("_processed_at")


def new_notifications(
    stream: DataFrame, by_account: bool = True, spread: int = 1, memory: str = MEMORY
) -> DataFrame:
    """Notifications with a new history id, per account.

    ``by_account=False`` keys on the history id alone: two accounts that happen to share
    an id then collide.
    """
    keys = ["account", "history_id"] if by_account else ["history_id"]
    return first_seen(stream, keys, memory, spread)


def new_messages(stream: DataFrame, spread: int = 1, memory: str = MEMORY) -> DataFrame:
    """Message ids not seen before; a repeat inside one micro-batch is dropped as well."""
    return first_seen(stream, ["message_id"], memory, spread)
