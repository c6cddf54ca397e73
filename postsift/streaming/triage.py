"""Mail triage, cursors and delivery marks per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queue, routing, rules, scoring, state
from ..session import remove, scratch_path, stage_at
from ..sources.attachments import STORE, with_attachments
from ..sources.messages import parse_messages
from ..sources.tables import STATE, RuleConfig
from ..tables.seen import SeenIds
from ..tables.versioned import BUCKETS, VersionedTable
from . import limits
from .tables import read_all, read_batch, write_batch

Sink = Callable[[DataFrame, int], None]


def triage(
    path: str,
    scorer: scoring.Scorer,
    config: RuleConfig = RuleConfig(),
    column: str = "message",
    charset: str = "ISO-8859-1",
    store: DataFrame | None = None,
    quota: int | None = None,
    seen_buckets: int = BUCKETS,
) -> Sink:
    """Raw messages ``(message JSON, received_at)`` to settled mail and its consequences.

    Attachments are taken from the messages and from ``store(message_id, attachment_id,
    data)`` before anything is scored. Every row ends in exactly one of three tables: one
    that cannot be read in ``quarantine``, one whose id an earlier row has, in this or an
    earlier micro-batch, in ``duplicates``, and all others in ``settled``. The settled batch
    is written first and everything else is derived from what was written, so a scorer that
    answers differently on a retry cannot split a mail between routes: ``immediate``
    notifications, ``queue`` rows, mailbox ``actions``, the ``log``, and ``alerts`` for what
    could not be read. With ``quota`` the scorer is one service behind the daily quota and the
    breaker, which go on from micro-batch to micro-batch by ``received_at``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = scratch_path(spark, "triage")
        started = F.lit(_now(spark)).cast("bigint")
        try:
            _settle(batch, batch_id, work)
        finally:
            remove(spark, work)
        settled = read_batch(spark, f"{path}/settled", batch_id)
        seen = SeenIds(spark, f"{path}/seen", seen_buckets)
        seen.add(settled.select("id", F.col("received_at").cast("bigint").alias("seen_at")), batch_id)
        seen.vacuum()
        urgent = settled.where("route = 'immediate'")
        write_batch(routing.immediate_notifications(urgent), f"{path}/immediate", batch_id)
        write_batch(queue.new_rows(settled), f"{path}/queue", batch_id)
        write_batch(routing.mailbox_actions(settled), f"{path}/actions", batch_id)
        bad = read_batch(spark, f"{path}/quarantine", batch_id)
        finished = F.lit(_now(spark)).cast("bigint")
        done = settled.select("id", "verdict", F.lit(None).cast("string").alias("error")).unionByName(
            bad.select("id", F.col("reject_reason").alias("error")), allowMissingColumns=True
        )
        timed = done.withColumns({"finished_at": finished, "duration_ms": finished - started})
        write_batch(routing.processing_log(timed), f"{path}/log", batch_id)
        alerts = routing.failure_alerts(bad.select("id", F.col("reject_reason").alias("error")))
        write_batch(alerts, f"{path}/alerts", batch_id)

    def _settle(batch: DataFrame, batch_id: int, work: str) -> None:
        spark = batch.sparkSession
        stored = spark.createDataFrame([], STORE) if store is None else store
        read = parse_messages(batch, column, charset)
        read = with_attachments(read, stored, staged_at=f"{work}/parsed")
        read = stage_at(read.withColumn("_row", F.monotonically_increasing_id()), f"{work}/read")
        bad = read.where("reject_reason IS NOT NULL").select(*_kept(batch, column), "id", "reject_reason")
        write_batch(bad, f"{path}/quarantine", batch_id)

        good = read.where("reject_reason IS NULL").drop("reject_reason")
        repeats = stage_at(_repeats(good, batch_id), f"{work}/repeats")
        write_batch(repeats.select("id", "received_at"), f"{path}/duplicates", batch_id)
        mail = good.join(repeats.select("_row"), "_row", "left_anti").drop("_row")
        ruled = rules.apply_rules(mail, config)
        if quota is None:
            settled = scoring.classify(ruled, scorer)
        else:
            carry, used = limits.limits_before(spark, path, batch_id)
            ts = F.coalesce(F.col("received_at").cast("bigint"), F.lit(0).cast("bigint"))
            called = ruled.withColumns({"service": F.lit("scorer"), "ts": ts})
            settled, states, now_used = scoring.classify_within_limits(called, scorer, carry, used, quota)
            limits.keep_limits(path, batch_id, carry, states, now_used)
        write_batch(
            routing.add_route(settled).select(
                "id",
                "from_addr",
                "subject",
                "attachment_text",
                F.size("images").alias("n_images"),
                "received_at",
                "verdict",
                "route",
            ),
            f"{path}/settled",
            batch_id,
        )

    def _repeats(good: DataFrame, batch_id: int) -> DataFrame:
        """Rows whose id has an earlier row here or in an earlier micro-batch; keys move alone.

        Settled ids are asked of an index, which opens only files that may hold one of them.
        """
        rows = good.select("id", "received_at", "_row")
        seen = SeenIds(good.sparkSession, f"{path}/seen", seen_buckets)
        first = rows.groupBy("id").agg(F.min(F.struct("received_at", "_row"))["_row"].alias("_row"))
        fresh = seen.unseen(first, before_batch=batch_id).select("_row")
        return rows.join(fresh, "_row", "left_anti")

    return run


def _now(spark: SparkSession) -> int:
    return spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0]


def _kept(batch: DataFrame, column: str) -> list[str]:
    return [c for c in batch.columns if c not in (column, "id")]


def keep_cursors(path: str) -> Sink:
    """Keep the latest cursor per account of the micro-batches ``(account, history_id, ts)``.

    A micro-batch rewrites the buckets of its own accounts. The cursor moves on even if some of
    the account's messages could not be read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        table = _cursors(batch.sparkSession, path)
        changes = batch.select(
            F.concat(F.lit(state.CURSOR_PREFIX), F.col("account")).alias("key"),
            F.col("history_id").alias("value"),
            F.col("ts").alias("updated_at"),
        )
        table.update(state.latest(changes), state.upsert, batch_id)
        table.vacuum()

    return run


def _cursors(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, STATE, "key")


def current_state(path: str, first: DataFrame) -> DataFrame:
    """``first`` with all changes that ``keep_cursors`` wrote."""
    return state.upsert(first, _cursors(first.sparkSession, path).read())


def mark_deliveries(path: str, flush: DataFrame, by: tuple[str, ...] = ("priority",)) -> Sink:
    """Note the queue ids of delivered chunks; ``batch(*by, chunk, delivered, ts)``.

    An id is noted only after its chunk's delivery, so a failed chunk stays queued and is
    sent again: at least once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        delivered = (
            batch.where("delivered").groupBy(*by, "chunk").agg(F.min("ts").alias("sent_at"))
        )
        chunks = flush.select("id", *by, "chunk")
        marks = chunks.join(delivered, [*by, "chunk"]).select("id", "sent_at")
        write_batch(marks, path, batch_id)

    return run


def current_queue(path: str, first: DataFrame) -> DataFrame:
    """``first`` with all marks that ``mark_deliveries`` wrote; the last mark counts."""
    marks = read_all(first.sparkSession, path).groupBy("id").agg(F.max("sent_at").alias("_at"))
    marked = first.join(marks, "id", "left").withColumn("sent_at", F.coalesce("_at", "sent_at"))
    return marked.select(*first.columns)
