"""Registered streaming queries: whole tables, fed in time order over several runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import kept_stats, queue, scoring
from ..operators.queue import FLUSH_ROWS
from ..session import scratch_path, stage
from ..sources import push
from ..sources.tables import PENDING, STATE
from ..streaming import counts, dedupe, digests, limits, ordered, tables, triage, windows
from ..tables.versioned import VersionedTable
from . import fixtures as fx
from .catalog import SMALL_CAP, SMALL_QUOTA, _flat, query

PARTS = 3


def feed_in_parts(
    rows: DataFrame, order: str, start: Callable[[DataFrame], DataStreamWriter]
) -> None:
    """Write ``rows`` to a folder part by part and run the stream to its end after each.

    Every run resumes from the checkpoint of the run before.
    """
    feed_runs(parts_of(rows, order), start, scratch_path(rows.sparkSession, "stream"))


def parts_of(rows: DataFrame, order: str) -> list[DataFrame]:
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = (high - low) // PARTS + 1
    begins = [low + part * step for part in range(PARTS)]
    return [rows.where((F.col(order) >= begin) & (F.col(order) < begin + step)) for begin in begins]


def feed_runs(parts: list[DataFrame], start: Callable[[DataFrame], DataStreamWriter], folder: str) -> None:
    """A run of the stream for each part, from the checkpoint of the run before."""
    for rows in parts:
        rows.write.mode("append").parquet(f"{folder}/rows")
        source = rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/rows")
        run = start(source).option("checkpointLocation", f"{folder}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, path: str) -> DataStreamWriter:
    return stream.writeStream.outputMode("append").foreachBatch(
        lambda batch, batch_id: tables.write_batch(batch, path, batch_id)
    )


def to_sink(sink: triage.Sink) -> Callable[[DataFrame], DataStreamWriter]:
    return lambda source: source.writeStream.foreachBatch(sink)


@query
def stream_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Push bodies, decoded; the bad ones left out, each history id once."""
    out = scratch_path(spark, "notifications")

    def start(source: DataFrame) -> DataStreamWriter:
        good = push.accepted(push.decode_envelopes(source))
        fresh = dedupe.new_notifications(good, spread=4)
        return to_table(fresh.select("account", "history_id"), out)

    feed_in_parts(fx.read_view(spark, sf_dir, "fx_push"), "ts", start)
    return tables.read_all(spark, out)


@query
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message ids of the feed, each once."""
    out = scratch_path(spark, "messages")

    def start(source: DataFrame) -> DataStreamWriter:
        return to_table(dedupe.new_messages(source).select("message_id"), out)

    rows = fx.read_view(spark, sf_dir, "fx_feed").where("message_id IS NOT NULL")
    feed_in_parts(rows, "received_at", start)
    return tables.read_all(spark, out)


@query
def stream_flush_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals per flush, for every flush."""
    out = scratch_path(spark, "flushes")
    rows = fx.pending(spark, sf_dir).select("priority", "received_at")
    feed_in_parts(rows, "received_at", to_sink(windows.count_flushes(out)))
    return windows.flush_counts(spark, out)


@query
def stream_limited_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "limits")
    calls = fx.read_view(spark, sf_dir, "fx_call")
    feed_in_parts(calls, "ts", to_sink(limits.limit_calls(out, quota=SMALL_QUOTA)))
    return tables.read_all(spark, f"{out}/calls").select("id", "outcome")


@query
def stream_ordered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for calls that arrive up to an hour out of order, held back until all are there.

    A last call long after the others lets the rest go.
    """
    out = scratch_path(spark, "limits")
    calls = fx.read_view(spark, sf_dir, "fx_call")
    columns = calls.columns
    hour = 3_600_000
    arrived = stage(calls.withColumn("arrived", F.col("ts") + F.pmod(F.hash("id"), F.lit(hour))), "arrivals")
    end = calls.orderBy(F.desc("ts"), F.desc("id")).limit(1).withColumn("id", F.lit(-1).cast("bigint"))
    end = end.withColumn("ts", F.col("ts") + 3 * hour).select(*columns)
    parts = [p.select(*columns) for p in parts_of(arrived, "arrived")] + [stage(end, "end")]
    sink = ordered.in_order(f"{out}/order", limits.limit_calls(out, quota=SMALL_QUOTA), hour)
    feed_runs(parts, to_sink(sink), scratch_path(spark, "stream"))
    return tables.read_all(spark, f"{out}/calls").select("id", "outcome")


@query
def stream_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "cursors")
    notes = fx.read_view(spark, sf_dir, "fx_notification")
    feed_in_parts(notes, "ts", to_sink(triage.keep_cursors(out)))
    return triage.current_state(out, spark.createDataFrame([], STATE))


@query
def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message ends in exactly one of discard, immediate, queue, quarantine and duplicate.

    The readable ones of every seventh document come again, most in a later micro-batch.
    """
    out = scratch_path(spark, "triage")
    words = {"Critical": ("verification code",), "High": ("ssn", "card"), "Medium": ("bearer",)}
    rows = fx.provider_messages(spark, sf_dir).select(
        "doc_id", "message", F.col("doc_id").alias("received_at")
    )
    again = rows.where("doc_id % 7 = 0 AND doc_id % 50 <> 49").withColumn(
        "received_at", F.col("doc_id") * 2 + 1
    )
    store = stage(fx.attachment_store(spark, sf_dir), "store")  # a table, not a view, to every micro-batch
    sink = triage.triage(out, scoring.keyword_scorer(words), charset="UTF-8", store=store)
    feed_in_parts(stage(rows.unionByName(again), "mail"), "received_at", to_sink(sink))
    bad = tables.read_all(spark, f"{out}/quarantine").select(
        F.concat(F.lit("msg"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("quarantine").alias("route"),
    )
    twice = tables.read_all(spark, f"{out}/duplicates").select("id", F.lit("duplicate").alias("route"))
    settled = tables.read_all(spark, f"{out}/settled").select(
        "id", "route", "verdict.priority", F.md5("attachment_text").alias("attached"), "n_images"
    )
    queued = tables.read_all(spark, f"{out}/queue").select("id", F.lit(1).alias("queued"))
    urgent = tables.read_all(spark, f"{out}/immediate").select("id", "title")
    told = settled.join(queued, "id", "left").join(urgent, "id", "left")
    return told.unionByName(bad, allowMissingColumns=True).unionByName(twice, allowMissingColumns=True)


@query
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery outcomes of the next flush's chunks, marked as they arrive.

    Every scoring call stands for an attempt at one chunk.
    """
    out = scratch_path(spark, "deliveries")
    pending = fx.pending(spark, sf_dir)
    flush = queue.oldest_unsent(pending).select("id", "priority", "chunk")
    attempts = fx.read_view(spark, sf_dir, "fx_call").selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'High' ELSE 'Low' END AS priority",
        "cast(id % 5 as int) AS chunk",
        "ok AND id % 5 <> 2 AS delivered",
        "ts",
    )
    feed_in_parts(attempts, "ts", to_sink(triage.mark_deliveries(out, flush)))
    return triage.current_queue(out, pending).select("id", "sent_at")


# Long after the last arrival: every flush of every queue is over.
ALL_SENT = fx.NOW_MS + 3650 * 86_400_000


def _digest_events(df: DataFrame) -> DataFrame:
    """Rows of the stream's schema, null where ``df`` lacks a column."""
    empty = df.sparkSession.createDataFrame([], digests.EVENTS)
    return empty.unionByName(df, allowMissingColumns=True).select(*empty.columns)


def _send_all(spark: SparkSession, sf_dir: str, out: str, folder: str, cap: int = FLUSH_ROWS) -> None:
    """The whole queue in parts of time, then a row that only moves the clock."""
    rows = fx.pending(spark, sf_dir).drop("sent_at")
    end = spark.range(1).select(F.lit(ALL_SENT).cast("bigint").alias("at"))
    parts = [_digest_events(part) for part in [*parts_of(rows, "received_at"), end]]
    feed_runs(parts, to_sink(digests.scheduled_digests(out, cap)), folder)


@query
def stream_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every tick that ever flushed, as the schedule sends them."""
    out = scratch_path(spark, "digests")
    _send_all(spark, sf_dir, out, scratch_path(spark, "stream"))
    return _flat(digests.digests_sent(spark, out)).drop("flush_at")


@query
def stream_digest_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all digests come back: rows of the second chunk of every flush wait again."""
    out, folder = scratch_path(spark, "digests"), scratch_path(spark, "stream")
    _send_all(spark, sf_dir, out, folder)
    told = digests.digests_sent(spark, out).select(
        "priority", "flush_at", "chunk", (F.col("chunk") != 1).alias("delivered"),
        (F.col("flush_at") + F.col("chunk") * 1000).alias("at"),
    )
    feed_runs([_digest_events(stage(told, "told"))], to_sink(digests.scheduled_digests(out)), folder)
    waiting = digests.queue_table(spark, out).read()
    state = F.when(F.col("flush_at").isNull(), "waiting").otherwise("in flight")
    return (
        digests.marks(spark, out)
        .select("id", "sent_at", F.lit("sent").alias("state"))
        .unionByName(waiting.select("id", F.lit(None).cast("bigint").alias("sent_at"), state.alias("state")))
    )


@query
def stream_flush_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which flush sends each row at a small cap, told as the flushes go out."""
    out = scratch_path(spark, "digests")
    _send_all(spark, sf_dir, out, scratch_path(spark, "stream"), SMALL_CAP)
    return digests.queue_table(spark, out).read().select("id", "priority", "flush_at")


@query
def stream_kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsent rows per priority, kept while a stream fills the queue and marks what is Low."""
    out = scratch_path(spark, "kept")

    def table(spark: SparkSession) -> VersionedTable:
        return VersionedTable(spark, f"{out}/queue", PENDING, "id")

    def kept(spark: SparkSession) -> kept_stats.KeptPending:
        return kept_stats.KeptPending(table(spark), f"{out}/counts")

    def fill(batch: DataFrame, batch_id: int) -> None:
        at = F.when(F.col("priority") == "Low", F.col("received_at")).otherwise(F.col("sent_at"))
        table(batch.sparkSession).insert(batch.withColumn("sent_at", at), batch_id)

    sink = counts.with_counts(fill, lambda spark: [kept(spark)])
    feed_in_parts(fx.pending(spark, sf_dir), "received_at", to_sink(sink))
    return kept(spark).by_priority()
