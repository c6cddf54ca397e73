"""Statistics that are kept as their tables change, instead of counted anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY_MS, HOUR_MS, utc_day_key, utc_month_start
from ..tables.counts import KeptCounts
from ..tables.versioned import Version, VersionedTable
from .stats import is_daily_call, with_all_queues

# Instants of one hour lie together, so the hour that a day begins in is one of these buckets.
HOUR_BUCKETS = 64


def hour_of(at: Column) -> Column:
    """Number of the hour that ends with ``at`` or after it: a bound itself is the hour's last instant.

    What is later than a full hour is then exactly what lies in later hours.
    """
    return F.floor((at - F.lit(1)) / F.lit(HOUR_MS)).cast("bigint")


class KeptPending:
    """Unsent rows per priority of a queue table, mailboxes apart if ``mailbox`` names columns."""

    def __init__(self, table: VersionedTable, path: str, mailbox: tuple[str, ...] = ()):
        dims = {c: F.col(c) for c in (*mailbox, "priority")}
        self.counts = KeptCounts(table, path, dims, where=F.col("sent_at").isNull())

    def refresh(self) -> Version:
        return self.counts.refresh()

    def by_priority(self) -> DataFrame:
        """``(priority, n)`` as ``stats.pending_counts`` tells them."""
        return with_all_queues(self.counts.read().groupBy("priority").agg(F.sum("n").alias("n")))


class KeptProcessed:
    """Processed rows of the last 24 hours and of the month, for any time they are asked at.

    Two levels: instants by hour, and sums of hours counted on them. A question adds up hours, and
    instants only of the hour that the day begins in, as of the version that the hours tell of.
    """

    def __init__(self, table: VersionedTable, path: str):
        at = F.col("processed_at")
        self.instants = KeptCounts(
            table,
            f"{path}/instants",
            {"hour": hour_of(at), "at": at},
            where=at.isNotNull(),
            together=("hour",),
            buckets=HOUR_BUCKETS,
        )
        self.hours = KeptCounts(self.instants.kept, f"{path}/hours", {"hour": F.col("hour")}, weight="n")

    def refresh(self) -> Version:
        self.instants.refresh()
        return self.hours.refresh()

    def at(self, now_ms: int) -> DataFrame:
        """``(processed_today, processed_month)`` as ``stats.processed_counts`` tells them."""
        since = now_ms - DAY_MS
        begins = (since - 1) // HOUR_MS
        month = hour_of(utc_month_start(F.lit(now_ms).cast("bigint")))
        hour = F.col("hour")
        begun = self.instants.read_one(F.lit(begins).cast("bigint"), version=self.hours.stands_at())
        parts = (
            begun.where(F.col("at") > since)
            .select(F.lit(True).alias("today"), F.lit(False).alias("month"), "n")
            .unionByName(self.hours.read().select((hour > begins).alias("today"), (hour > month).alias("month"), "n"))
        )

        def total(name: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col(name), F.col("n"))), F.lit(0)).alias(f"processed_{name}")

        return parts.agg(total("today"), total("month"))


class KeptDaily:
    """Successful scored calls per UTC day of a table of results ``(ts, method)``."""

    def __init__(self, table: VersionedTable, path: str):
        self.counts = KeptCounts(table, path, {"day": utc_day_key(F.col("ts"))}, where=is_daily_call())

    def refresh(self) -> Version:
        return self.counts.refresh()

    def by_day(self) -> DataFrame:
        """``(day, n)`` as ``stats.daily_classifications`` tells them."""
        return self.counts.read()
