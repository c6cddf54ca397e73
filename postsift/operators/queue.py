"""The delivery queue: inserts, flushes, marks, replay, retention.

A table update is a function from the old snapshot and its changes to the new snapshot;
the caller writes that to a new place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY_MS, HOUR_MS, MINUTE_MS
from .ranking import positions

# Rows per flush, mails per digest, memory of sent and processed rows.
FLUSH_ROWS = 100
CHUNK_ROWS = 20
SENT_MEMORY_MS = DAY_MS
PROCESSED_MEMORY_MS = 2 * DAY_MS

# Flush period and phase (offset from midnight UTC) per priority.
FLUSH_SCHEDULE = {
    "High": (30 * MINUTE_MS, 0),
    "Medium": (HOUR_MS, 0),
    "Low": (2 * HOUR_MS, 0),
    "Not Necessary": (DAY_MS, 17 * HOUR_MS),
}


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    The rank filter is pushed below the shuffle, so a key with very many copies sends one
    row per task.
    """
    first = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(first))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Old rows, plus new rows whose key is unknown; of new rows with one key the first."""
    absent = first_per_key(new, key, order).join(old.select(key), key, "left_anti")
    return old.unionByName(absent)


def new_rows(mail: DataFrame) -> DataFrame:
    """Queue rows for classified mail that is neither Critical nor Ignore, once per id."""
    rows = mail.where(~F.col("verdict.priority").isin("Critical", "Ignore")).select(
        "id",
        "from_addr",
        "subject",
        F.col("verdict.summary").alias("summary"),
        F.col("verdict.priority").alias("priority"),
        "received_at",
        F.lit(None).cast("bigint").alias("sent_at"),
    )
    return first_per_key(rows, "id", ["received_at", "subject", "from_addr", "summary"])


def enqueue(pending: DataFrame, mail: DataFrame) -> DataFrame:
    """Append if absent."""
    return pending.unionByName(new_rows(mail).join(pending.select("id"), "id", "left_anti"))


def unsent(pending: DataFrame) -> DataFrame:
    return pending.where(F.col("sent_at").isNull())


def oldest_unsent(
    pending: DataFrame, limit: int = FLUSH_ROWS, by: tuple[str, ...] = ("priority",)
) -> DataFrame:
    """The next flush of every queue: oldest rows first, with ``pos`` and ``chunk``.

    Several mailboxes in one table: put the mailbox in ``by``.
    """
    oldest = Window.partitionBy(*by).orderBy("received_at", "id")
    ranked = unsent(pending).withColumn("pos", F.row_number().over(oldest))
    return ranked.where(F.col("pos") <= limit).withColumn("chunk", chunk_of(F.col("pos")))


def chunk_of(pos: Column, size: int = CHUNK_ROWS) -> Column:
    return F.floor((pos - 1) / F.lit(size)).cast("int")


def tick_of(priority: Column, received_at: Column) -> Column:
    """Number of the flush window a row arrives in; NULL if its priority has no schedule."""
    tick = F.lit(None).cast("bigint")
    for name, (period, phase) in FLUSH_SCHEDULE.items():
        index = F.floor((received_at - F.lit(phase)) / F.lit(period)).cast("bigint")
        tick = F.when(priority == name, index).otherwise(tick)
    return tick


def tick_end(priority: Column, tick: Column) -> Column:
    """When flush window ``tick`` is sent, in epoch ms."""
    end = F.lit(None).cast("bigint")
    for name, (period, phase) in FLUSH_SCHEDULE.items():
        end = F.when(priority == name, (tick + 1) * F.lit(period) + F.lit(phase)).otherwise(end)
    return end


def next_flush(after_ms: int) -> int:
    """End of the first flush window, of any priority, that is still open at ``after_ms``."""
    return min((after_ms - phase) // period * period + period + phase for period, phase in FLUSH_SCHEDULE.values())


def assign_flush(
    queue: DataFrame,
    cap: int = FLUSH_ROWS,
    by: tuple[str, ...] = ("priority",),
    from_ms: int | None = None,
) -> DataFrame:
    """Which tick sends each row of a queue that sends at most ``cap`` rows per tick.

    Every combination of ``by`` is a queue of its own; several mailboxes in one table: put the
    mailbox in ``by``, next to ``priority``, which names the schedule. With ``from_ms``, flushes up to
    then are over: rows that arrived for one of them count as arriving for the first that is not.

    First come first served at ``cap`` rows a tick: with ``before(s)`` the rows that arrive
    before tick ``s``, row number ``pos`` arriving at tick ``a`` leaves in tick
    ``ceil((pos + max over s <= a of (cap * s - before(s))) / cap) - 1``. The maximum runs
    over one row per tick with arrivals, so rows only need an equi join with their own tick.
    """
    tick = tick_of(F.col("priority"), F.col("received_at"))
    if from_ms is not None:
        tick = F.greatest(tick, tick_of(F.col("priority"), F.lit(from_ms).cast("bigint")))
    scheduled = queue.withColumn("tick", tick).where(F.col("tick").isNotNull())
    placed = positions(scheduled, list(by), ["received_at", "id"])
    up_to = Window.partitionBy(*by).orderBy("tick")
    earlier = up_to.rowsBetween(Window.unboundedPreceding, -1)
    arrivals = placed.groupBy(*by, "tick").agg(F.count(F.lit(1)).alias("_n"))
    shift = F.max(F.lit(cap) * F.col("tick") - F.col("_before")).over(
        up_to.rowsBetween(Window.unboundedPreceding, 0)
    )
    ticks = arrivals.withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ).select(*by, "tick", shift.alias("_shift"))
    sent = (F.ceil((F.col("pos") + F.col("_shift")) / F.lit(cap)) - 1).cast("bigint")
    return (
        placed.join(ticks, [*by, "tick"])
        .withColumn("sent_tick", sent)
        .withColumn("flush_at", tick_end(F.col("priority"), F.col("sent_tick")))
        .drop("_shift")
    )


def flush_windows(queue: DataFrame) -> DataFrame:
    """Arrivals per flush window: ``(priority, flush_at, n)``."""
    tick = tick_of(F.col("priority"), F.col("received_at"))
    return (
        queue.select("priority", tick_end(F.col("priority"), tick).alias("flush_at"))
        .where(F.col("flush_at").isNotNull())
        .groupBy("priority", "flush_at")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mark_sent(pending: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """Stamp the listed ids, also ones already sent."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    stamped = F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("sent_at"))
    return pending.join(hit, "id", "left").withColumn("sent_at", stamped).select(*pending.columns)


def needs_replay(since_ms: int) -> Column:
    """Received or sent since then; an unsent row counts by its arrival alone."""
    since = F.lit(since_ms)
    received = F.col("received_at") >= since
    return F.coalesce(received | (F.col("sent_at") >= since), F.lit(False))


def replay(pending: DataFrame, since_ms: int) -> DataFrame:
    reset = F.when(needs_replay(since_ms), F.lit(None)).otherwise(F.col("sent_at"))
    return pending.withColumn("sent_at", reset.cast("bigint"))


def replayed_rows(pending: DataFrame, since_ms: int) -> DataFrame:
    """How many rows a replay touches, counting rows that were unsent anyway."""
    return pending.agg(F.count_if(needs_replay(since_ms)).alias("rows_reset"))


def retain_pending(pending: DataFrame, now_ms: int, memory_ms: int = SENT_MEMORY_MS) -> DataFrame:
    """Forget rows sent longer ago than that; unsent rows never expire."""
    return pending.where(F.col("sent_at").isNull() | (F.col("sent_at") >= now_ms - memory_ms))


def retain_processed(
    processed: DataFrame, now_ms: int, memory_ms: int = PROCESSED_MEMORY_MS
) -> DataFrame:
    return processed.where(F.col("processed_at") >= now_ms - memory_ms)
