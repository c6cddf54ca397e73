"""Schemas of the stored tables and readers that state them explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

STATE = "key string, value string, updated_at bigint"
PROCESSED_HISTORY = "history_id string, processed_at bigint"
PROCESSED_MESSAGES = "message_id string, processed_at bigint"
PENDING = (
    "id string, from_addr string, subject string, summary string, priority string, "
    "received_at bigint, sent_at bigint"
)
TABLES = {
    "state": STATE,
    "processed_history": PROCESSED_HISTORY,
    "processed_messages": PROCESSED_MESSAGES,
    "pending_emails": PENDING,
}


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)


@dataclass(frozen=True)
class RuleConfig:
    """Labels to ignore and senders to trust.

    Fixed values: the default labels and the default trusted domain.
    """

    ignore_labels: tuple[str, ...] = ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "SPAM")
    allowlist: tuple[str, ...] = field(default=("@yourcompany.com",))


def read_rules(spark: SparkSession, path: str) -> RuleConfig:
    """A rules file: one JSON object with ``ignoreLabels`` and ``allowlist``.

    One configuration object, so it is read on the driver and becomes literals. A
    trusted-sender list that is itself a large table goes to
    ``operators.rules.trusted_by_table`` instead.
    """
    row = (
        spark.read.schema("ignoreLabels array<string>, allowlist array<string>")
        .json(path, multiLine=True)
        .first()
    )
    return RuleConfig(tuple(row.ignoreLabels or ()), tuple(row.allowlist or ()))
