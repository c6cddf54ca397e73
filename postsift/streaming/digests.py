"""Digests that a schedule sends, from a stream of queue rows and delivery outcomes.

Event time is the clock: it stands at the latest time any row has stated. When it passes the end of
a flush window, that flush is sent: of every queue the oldest rows up to the cap, in chunks, one
digest a chunk. Rows that were sent wait in flight for the outcome of their chunk, which comes back as
input. A delivered chunk's rows are marked and leave; a failed one's are queued again, at their old
place, and go with the next flush. Rows that come late go with the next flush as well, so none is
lost.

The queue is a versioned table of what is not delivered yet, with the clock in its notes. All flushes
that a micro-batch makes due are worked out together by the closed form of ``assign_flush``, whatever
their number, and no queue has to fit in one task, as it would with a timer and a list a key. A
micro-batch that is retried starts from the version before it and writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, queue
from ..session import remove, scratch_path, stage_at
from ..tables.versioned import VersionedTable
from .tables import read_all, write_batch

ROW = "id string, from_addr string, subject string, summary string, priority string, received_at bigint"
FLIGHT = "flush_at bigint, chunk int"
# What the stream reads: a queue row; or the outcome of a chunk, which states its queue, ``flush_at``,
# ``chunk``, ``delivered`` and ``at``; or only ``at``, which moves the clock.
EVENTS = f"{ROW}, {FLIGHT}, delivered boolean, at bigint"


def queue_table(spark: SparkSession, path: str, mailbox: tuple[str, ...] = ()) -> VersionedTable:
    schema = ", ".join([*[f"{c} string" for c in mailbox], ROW, FLIGHT])
    return VersionedTable(spark, f"{path}/queue", schema, "id")


def scheduled_digests(
    path: str, cap: int = queue.FLUSH_ROWS, mailbox: tuple[str, ...] = ()
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``EVENTS`` and the columns ``mailbox``, which with the priority
    name a queue; writes ``digests`` and ``marks`` below ``path``.
    """
    by = (*mailbox, "priority")

    def run(batch: DataFrame, batch_id: int) -> None:
        work = scratch_path(batch.sparkSession, "digests")
        try:
            _step(stage_at(batch, f"{work}/events"), batch_id, work)
        finally:
            remove(batch.sparkSession, work)

    def _step(events: DataFrame, batch_id: int, work: str) -> None:
        table = queue_table(events.sparkSession, path, mailbox)
        version = table.current(batch_id)
        before = version.notes.get("clock")
        stated = events.agg(F.max(F.coalesce("at", "received_at"))).first()[0]
        clock = max((t for t in (before, stated) if t is not None), default=None)
        old = table.rows_of(version.files)

        told = _outcomes(events, by)
        flying = old.where("flush_at IS NOT NULL").join(told, [*by, *_names(FLIGHT)])
        flying = stage_at(flying, f"{work}/flying")
        done = flying.where("delivered")
        write_batch(done.select("id", *by, "flush_at", "chunk", "sent_at"), f"{path}/marks", batch_id)

        none = {c: F.lit(None).cast(kind) for c, kind in (f.split() for f in FLIGHT.split(", "))}
        back = flying.where("NOT delivered").withColumns(none)
        mail = events.where("flush_at IS NULL AND id IS NOT NULL").withColumns(none)
        fresh = queue.first_per_key(mail, "id", ["received_at", "from_addr", "subject", "summary"])
        fresh = fresh.join(old.select("id"), "id", "left_anti")
        moved = stage_at(back.select(*old.columns).unionByName(fresh.select(*old.columns)), f"{work}/moved")
        waiting = old.where("flush_at IS NULL").unionByName(moved)

        fired = old.limit(0)
        if clock is not None and (before is None or queue.next_flush(before) <= clock):
            due = queue.assign_flush(waiting.drop(*_names(FLIGHT)), cap, by, before).where(F.col("flush_at") <= clock)
            sent = stage_at(digest.tick_flushes(due, by), f"{work}/sent")
            rows = digest.digests(sent, (*by, "sent_tick", "flush_at"))
            write_batch(rows, f"{path}/digests", batch_id)
            fired = sent.select(*old.columns)
        changes = (
            fired.withColumn("gone", F.lit(False))
            .unionByName(moved.join(fired.select("id"), "id", "left_anti").withColumn("gone", F.lit(False)))
            .unionByName(done.select(*old.columns).withColumn("gone", F.lit(True)))
        )
        table.update(stage_at(changes, f"{work}/changes"), _replaced, batch_id, {"clock": clock})
        table.vacuum()

    return run


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _outcomes(events: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row a chunk: delivered if any outcome says so, and when first."""
    hit = F.coalesce("delivered", F.lit(False))
    return (
        events.where("flush_at IS NOT NULL")
        .groupBy(*by, *_names(FLIGHT))
        .agg(F.bool_or(hit).alias("delivered"), F.min(F.when(hit, F.col("at"))).alias("sent_at"))
    )


def _replaced(old: DataFrame, changes: DataFrame) -> DataFrame:
    kept = old.join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(changes.where("NOT gone").select(*old.columns))


def digests_sent(spark: SparkSession, path: str) -> DataFrame:
    """Every digest of every flush so far."""
    return read_all(spark, f"{path}/digests")


def marks(spark: SparkSession, path: str) -> DataFrame:
    """``(id, ..., sent_at)`` of delivered rows."""
    return read_all(spark, f"{path}/marks")
