"""Time is BIGINT epoch milliseconds; calendar steps are UTC whatever the session says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_MS = 1_000
MINUTE_MS = 60 * SECOND_MS
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS


def utc_date(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int"))


def utc_day_key(ms: Column) -> Column:
    """``YYYY-MM-DD``."""
    return utc_date(ms).cast("string")


def utc_month_start(ms: Column) -> Column:
    return F.unix_date(F.trunc(utc_date(ms), "month")).cast("bigint") * F.lit(DAY_MS)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
