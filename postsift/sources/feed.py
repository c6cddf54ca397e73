"""Change feed: which message ids are new for which account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY_MS
from ..tables.seen import SeenIds

HISTORY_PAGE = (
    "struct<historyId:string,history:array<struct<id:string,"
    "messagesAdded:array<struct<message:struct<id:string>>>>>>"
)
FALLBACK_MESSAGES = 10
FALLBACK_AGE_MS = DAY_MS
FIRST_HISTORY_ID = "1"


def history_number(history_id: Column) -> Column:
    """Ids are text; their order is that of the numbers."""
    return history_id.try_cast("decimal(38,0)")


def plan_sync(accounts: DataFrame, cursors: DataFrame, feed_status: DataFrame | None = None) -> DataFrame:
    """Per account: read the feed from which cursor, or fall back.

    ``accounts(account)``, ``cursors(account, cursor)``, ``feed_status(account, status)``
    with the HTTP status of the first feed read (absent means fine). A 401 reads the
    feed again from the cursor, or from the first id; any other error, and a missing
    cursor, fall back.
    """
    planned = accounts.join(cursors, "account", "left")
    if feed_status is None:
        planned = planned.withColumn("status", F.lit(200))
    else:
        planned = planned.join(feed_status, "account", "left")
    expired = (F.col("status") == 401) & F.col("cursor").isNotNull()
    fine = F.coalesce(F.col("status"), F.lit(200)).between(200, 299) & F.col("cursor").isNotNull()
    return planned.select(
        *accounts.columns,
        F.when(F.coalesce(fine | expired, F.lit(False)), "feed").otherwise("fallback").alias("mode"),
        F.coalesce("cursor", F.lit(FIRST_HISTORY_ID)).alias("start_id"),
    )


def parse_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    """Feed pages ``(account, page_no, page JSON)`` with the JSON read once."""
    return pages.withColumn("_page", F.from_json(page, HISTORY_PAGE)).drop(page)


def scan_feed(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """``(account, message_id)``: every "message added" entry after the start id."""
    start = plan.where(F.col("mode") == "feed").select("account", "start_id")
    # An entry or a start without a number cannot be placed: it counts as new rather than be lost.
    later = history_number(F.col("entry.id")) > history_number(F.col("start_id"))
    after = F.coalesce(later, F.lit(True))
    # Whole pages are joined: far fewer rows to shuffle than their entries.
    return (
        pages.join(start, "account")
        .select("account", "start_id", F.explode("_page.history").alias("entry"))
        .where(after)
        .select("account", F.explode("entry.messagesAdded").alias("added"))
        .select("account", F.col("added.message.id").alias("message_id"))
    )


def next_cursors(
    pages: DataFrame, plan: DataFrame, notified: DataFrame | None = None
) -> DataFrame:
    """``(account, cursor)``: where the next read starts.

    For the feed, the history id of the account's last page, or the start id if there is no
    page. For the fallback, the history id of the account's last notification
    ``notified(account, history_id, ts)``; without one it gets no cursor.
    """
    last = pages.groupBy("account").agg(
        F.max_by(F.col("_page.historyId"), F.col("page_no")).alias("last_id")
    )
    read = (
        plan.where(F.col("mode") == "feed")
        .join(last, "account", "left")
        .select("account", F.coalesce("last_id", "start_id").alias("cursor"))
    )
    if notified is None:
        return read
    told = notified.groupBy("account").agg(F.max_by("history_id", F.struct("ts", history_number(F.col("history_id")), "history_id")).alias("cursor"))
    fallen = plan.where(F.col("mode") == "fallback").select("account").join(told, "account")
    return read.unionByName(fallen)


def scan_fallback(
    messages: DataFrame,
    plan: DataFrame,
    now_ms: int,
    limit: int = FALLBACK_MESSAGES,
    age_ms: int = FALLBACK_AGE_MS,
) -> DataFrame:
    """Newest ``limit`` messages of the last day for accounts that cannot use the feed.

    ``messages(account, message_id, received_at)``. The rank filter is pushed below the
    shuffle (WindowGroupLimit), so a huge mailbox sends at most ``limit`` rows per task.
    """
    newest = Window.partitionBy("account").orderBy(F.col("received_at").desc(), "message_id")
    recent = messages.where(F.col("received_at") > F.lit(now_ms - age_ms))
    wanted = plan.where(F.col("mode") == "fallback").select("account")
    return (
        recent.join(wanted, "account", "left_semi")
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= limit)
        .select("account", "message_id")
    )


def unseen(ids: DataFrame, processed: DataFrame | SeenIds) -> DataFrame:
    """Message ids not processed yet, each once.

    ``processed`` is the table of all processed ids, or an index of them, of which only files are
    opened that may hold one of ``ids``.
    """
    once = ids.dropDuplicates(["account", "message_id"])
    if isinstance(processed, SeenIds):
        return processed.unseen(once, "message_id")
    return once.join(processed.select("message_id"), "message_id", "left_anti")


def incoming_ids(
    pages: DataFrame, messages: DataFrame, plan: DataFrame, processed: DataFrame | SeenIds, now_ms: int
) -> DataFrame:
    """Feed ids, or fallback ids, that are new."""
    found = scan_feed(pages, plan).unionByName(scan_fallback(messages, plan, now_ms))
    return unseen(found, processed)
