"""The priority dimension and the constant results that refer to it."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six priorities, highest first.
PRIORITIES = ("Critical", "High", "Medium", "Low", "Not Necessary", "Ignore")
QUEUED = ("High", "Medium", "Low", "Not Necessary")

# Number, tag and emoji of each priority that is ever announced.
NUMBER = {"Critical": 5, "High": 4, "Medium": 3, "Low": 2, "Not Necessary": 1}
TAG = {
    "Critical": "rotating_light",
    "High": "warning",
    "Medium": "envelope",
    "Low": "bell",
    "Not Necessary": "muted_speaker",
}
EMOJI = {
    "Critical": "🔴",
    "High": "🟠",
    "Medium": "🟡",
    "Low": "⚪",
    "Not Necessary": "⚫",
}

# Priority number on the push server; anything else is 5.
SERVER_PRIORITY = {5: 10, 4: 8, 3: 5, 2: 2, 1: 1}
SERVER_PRIORITY_DEFAULT = 5


def _lookup(mapping: dict, key: Column) -> Column:
    entries = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*entries), key)


def priority_number(priority: Column) -> Column:
    return _lookup(NUMBER, priority)


def priority_tag(priority: Column) -> Column:
    return _lookup(TAG, priority)


def priority_emoji(priority: Column) -> Column:
    return _lookup(EMOJI, priority)


def server_priority(number: Column) -> Column:
    return F.coalesce(_lookup(SERVER_PRIORITY, number), F.lit(SERVER_PRIORITY_DEFAULT))
