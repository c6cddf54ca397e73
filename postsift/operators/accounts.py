"""The set of watched accounts, ``(email, added_at)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_account, normalise_account

# Fixed value: stands for "the only account" until a real one is registered.
PLACEHOLDER = "__primary__"


def normalised(requests: DataFrame) -> DataFrame:
    """Requests with a clean ``email``; invalid addresses are in ``rejected``."""
    return requests.withColumn("email", normalise_account(F.col("email")))


def rejected(requests: DataFrame) -> DataFrame:
    return normalised(requests).where(~is_account(F.col("email")))


def add_accounts(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Set union: known accounts keep their place, new ones come after, each once."""
    known = accounts.where(F.col("email") != PLACEHOLDER)
    new = (
        normalised(requests)
        .where(is_account(F.col("email")))
        .groupBy("email")
        .agg(F.min("added_at").alias("added_at"))
        .join(known.select("email"), "email", "left_anti")
    )
    return known.select("email", "added_at").unionByName(new.select("email", "added_at"))


def remove_accounts(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    gone = normalised(requests).select("email")
    return accounts.where(F.col("email") != PLACEHOLDER).join(gone, "email", "left_anti")


def list_accounts(accounts: DataFrame, expiries: DataFrame, webhooks: DataFrame) -> DataFrame:
    """``(email, watch_expiry, last_webhook)``; both NULL where nothing is known."""
    return (
        accounts.where(F.col("email") != PLACEHOLDER)
        .select("email")
        .join(expiries.select("email", "watch_expiry"), "email", "left")
        .join(webhooks.select("email", "last_webhook"), "email", "left")
    )
