"""What happens to classified mail: discard, announce now, or queue; and what is noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.priorities import priority_emoji, priority_number, priority_tag
from ..functions.text import ALERT_CHARS, TITLE_SUBJECT_CHARS, sender_name

LABEL_PREFIX = "AI/"
ALERT_TITLE = "infra alert"


def route_of(priority: Column) -> Column:
    return (
        F.when(priority == "Ignore", "discard")
        .when(priority == "Critical", "immediate")
        .otherwise("queue")
    )


def add_route(mail: DataFrame) -> DataFrame:
    return mail.withColumn("route", route_of(F.col("verdict.priority")))


def immediate_title(priority: Column, sender: Column, subject: Column) -> Column:
    return F.concat(
        priority_emoji(priority),
        F.lit(" "),
        sender_name(sender),
        F.lit(": "),
        F.left(subject, F.lit(TITLE_SUBJECT_CHARS)),
    )


def immediate_notifications(mail: DataFrame, priority: Column | None = None) -> DataFrame:
    """One notification per mail; ``title, message, priority, tags, markdown``."""
    priority = F.col("verdict.priority") if priority is None else priority
    return mail.select(
        "id",
        immediate_title(priority, F.col("from_addr"), F.col("subject")).alias("title"),
        F.col("verdict.summary").alias("message"),
        priority_number(priority).alias("priority"),
        F.array(priority_tag(priority)).alias("tags"),
        F.lit(True).alias("markdown"),
    )


def mailbox_actions(mail: DataFrame) -> DataFrame:
    """Label to add, and ``UNREAD`` to remove unless Critical; nothing for Ignore.

    Labels go by name, or by id where mail has one from ``labels.with_label_id``: a mail without an
    id for its label then adds none and keeps its removal.
    """
    priority = F.col("verdict.priority")
    label = F.concat(F.lit(LABEL_PREFIX), F.col("verdict.label"))
    if "label_id" in mail.columns:
        label = F.col("label_id")
    return mail.where(priority != "Ignore").select(
        "id",
        F.array_compact(F.array(label)).alias("add_labels"),
        F.when(priority == "Critical", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("UNREAD")))
        .alias("remove_labels"),
    )


def processing_log(mail: DataFrame) -> DataFrame:
    """One JSON line per mail: outcome or error, never subject or body.

    ``mail(id, verdict, finished_at, duration_ms, error)``, ``error`` NULL for a success.
    """
    failed = F.col("error").isNotNull()
    line = F.to_json(
        F.struct(
            iso_time(F.col("finished_at")).alias("ts"),
            F.when(failed, "error").otherwise("info").alias("level"),
            F.when(failed, "email.process_error").otherwise("email.processed").alias("event"),
            F.col("id").alias("messageId"),
            *[
                F.when(~failed, F.col("verdict")[name]).alias(name)
                for name in ("priority", "label", "method")
            ],
            F.when(~failed, F.col("duration_ms")).alias("durationMs"),
            F.col("error").alias("error"),
        )
    )
    return mail.select("id", line.alias("line"))


def iso_time(ms: Column) -> Column:
    """``2024-01-31T00:00:00.000Z``, in UTC whatever the session's time zone is."""
    seconds = F.floor(ms / F.lit(1000))
    clock = F.date_format(
        F.make_timestamp_ntz(
            F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
        )
        + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")),
        "yyyy-MM-dd'T'HH:mm:ss",
    )
    return F.concat(clock, F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("Z"))


def failure_alerts(failures: DataFrame, title: str = ALERT_TITLE) -> DataFrame:
    """Alert notifications for failures ``(id, error)``."""
    return failures.where(F.col("error").isNotNull()).select(
        "id",
        F.lit(title).alias("title"),
        F.concat(F.lit("[SYSTEM] "), F.left("error", F.lit(ALERT_CHARS))).alias("message"),
        F.lit(5).alias("priority"),
        F.array(F.lit("rotating_light")).alias("tags"),
        F.lit(False).alias("markdown"),
    )
