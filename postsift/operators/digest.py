"""Digests: queue rows of one flush, in chunks, grouped by sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.priorities import priority_number, priority_tag, server_priority
from ..functions.text import message_link, sender_name
from .queue import chunk_of

# Fixed value: sender names shown in a digest title.
MAX_NAMES = 4
# Fixed value: highest attempt number of a delivery (the first one is 0).
LAST_ATTEMPT = 3


def sender_groups(flush: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row per sender of a chunk: ``first_pos, n, name, rows`` in queue order.

    ``flush`` has ``pos``, ``chunk`` and the queue columns. A chunk has at most 20 rows,
    which bounds every list below.
    """
    row = F.struct("pos", "id", "summary")
    return (
        flush.withColumn("name", sender_name(F.col("from_addr")))
        .groupBy(*by, "chunk", "name")
        .agg(
            F.min("pos").alias("first_pos"),
            F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list(row)).alias("rows"),
        )
    )


def _link(row: Column) -> Column:
    return F.concat(F.lit("[link →]("), message_link(row["id"]), F.lit(")"))


def _bullet() -> Column:
    """One line for a single mail; summaries, then links, for several."""
    only = F.element_at("rows", 1)
    single = F.concat(
        F.lit("- **"), F.col("name"), F.lit("**: "), only["summary"], F.lit(" "), _link(only)
    )
    summaries = F.transform("rows", lambda r: F.concat(F.lit("  - "), r["summary"]))
    several = F.concat(
        F.lit("- **"),
        F.col("name"),
        F.lit("** ("),
        F.col("n").cast("string"),
        F.lit("):\n"),
        F.array_join(summaries, "\n"),
        F.lit("\n  "),
        F.array_join(F.transform("rows", _link), " "),
    )
    return F.when(F.col("n") == 1, single).otherwise(several)


def _title() -> Column:
    names = F.transform("groups", lambda g: g["name"])
    extra = F.size("groups") - F.lit(MAX_NAMES)
    return F.concat(
        F.lit("["),
        F.col("n").cast("string"),
        F.when(F.col("n") > 1, " emails] ").otherwise(" email] "),
        F.array_join(F.slice(names, 1, MAX_NAMES), ", "),
        F.when(extra > 0, F.concat(F.lit(" +"), extra.cast("string"), F.lit(" more"))).otherwise(""),
    )


def digests(flush: DataFrame, by: tuple[str, ...] = ("priority",)) -> DataFrame:
    """One digest per chunk: ``title, message, priority number, tags, markdown``."""
    group = F.struct("first_pos", "name", _bullet().alias("bullet"))
    chunks = (
        sender_groups(flush, by)
        .groupBy(*by, "chunk")
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(group)).alias("groups"))
    )
    return chunks.select(
        *by,
        "chunk",
        "n",
        _title().alias("title"),
        F.array_join(F.transform("groups", lambda g: g["bullet"]), "\n\n").alias("message"),
        priority_number(F.col("priority")).alias("priority_number"),
        F.array(priority_tag(F.col("priority"))).alias("tags"),
        F.lit(True).alias("markdown"),
    )


def tick_flushes(assigned: DataFrame, by: tuple[str, ...] = ("priority",)) -> DataFrame:
    """Chunk a whole history of flushes: queue position within the sending tick.

    ``assigned`` comes from ``assign_flush``; a tick sends at most its cap.
    """
    first = assigned.groupBy(*by, "sent_tick").agg(F.min("pos").alias("_first"))
    within = F.col("pos") - F.col("_first") + 1
    return (
        assigned.join(first, [*by, "sent_tick"])
        .withColumn("chunk", chunk_of(within))
        .drop("_first")
    )


def server_payload(title: Column, message: Column, number: Column) -> Column:
    """The push server's JSON body."""
    markdown = F.struct(F.lit("text/markdown").alias("contentType"))
    extras = F.struct(markdown.alias("client::display"), F.struct().alias("client::notification"))
    return F.to_json(
        F.struct(
            title.alias("title"),
            message.alias("message"),
            server_priority(number).alias("priority"),
            extras.alias("extras"),
        )
    )


def deliveries(notifications: DataFrame) -> DataFrame:
    """Notification rows as they go out."""
    return notifications.withColumn("server_priority", server_priority(F.col("priority"))).withColumn(
        "content_type", F.lit("text/markdown")
    )


def delivery_outcome(attempts: DataFrame) -> DataFrame:
    """Delivered if any of the first four attempts went through: ``(payload_id, delivered)``."""
    ok = F.col("ok") & (F.col("attempt_no") <= LAST_ATTEMPT)
    return attempts.groupBy("payload_id").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("delivered"))


def delivered_ids(flush: DataFrame, outcome: DataFrame, by: tuple[str, ...] = ("priority",)) -> DataFrame:
    """Queue ids of delivered chunks; a failed chunk stays queued.

    ``outcome(*by, chunk, delivered)``.
    """
    done = outcome.where("delivered").select(*by, "chunk")
    return flush.join(done, [*by, "chunk"], "left_semi").select("id")
