"""Rule cascade: trusted senders, ignored labels, newsletters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RULE_SUMMARY_CHARS, or_empty, sender_address
from ..session import stage
from ..sources.tables import RuleConfig

VERDICT = "struct<priority:string,summary:string,label:string,method:string>"


def is_trusted(sender: Column, allowlist: tuple[str, ...]) -> Column:
    """``@domain`` entries match as a suffix, all others as the whole address."""
    address = sender_address(sender)
    tests = [
        F.endswith(address, F.lit(e.lower())) if e.startswith("@") else address == e.lower()
        for e in allowlist
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def trusted_by_table(mail: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Add ``trusted`` from an allowlist table ``(entry)`` of any size.

    A suffix match would be a nested-loop join. An ``@domain`` entry can only match from an ``@``
    on, so a distinct address has a few keys: itself and its suffixes from every ``@`` on. They are
    looked up by an equi join, and the mail joins the addresses that hit, which are written first, so that
    AQE can split a hot address. Mail is read twice, once for its addresses alone.
    """
    entries = allowlist.select(F.lower("entry").alias("_key"))
    keyed = mail.withColumn("_address", sender_address(F.col("from_addr")))
    pieces = F.split("_address", "@")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))),
        lambda i: F.concat(F.lit("@"), F.array_join(F.slice(pieces, i, F.size(pieces)), "@")),
    )
    keys = F.when(F.contains("_address", F.lit("@")), F.array_append(suffixes, F.col("_address")))
    hits = (
        keyed.select("_address")
        .where("_address IS NOT NULL")
        .distinct()
        .select("_address", F.explode(F.coalesce(keys, F.array("_address"))).alias("_key"))
        .join(entries, "_key", "left_semi")
        .select("_address", F.lit(True).alias("_hit"))
        .distinct()
    )
    joined = keyed.join(stage(hits, "trusted"), "_address", "left")
    return joined.select(*mail.columns, F.coalesce("_hit", F.lit(False)).alias("trusted"))


def has_ignored_label(labels: Column, ignore_labels: tuple[str, ...]) -> Column:
    ignored = F.array(*[F.lit(label) for label in ignore_labels]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(labels, ignored), F.lit(False))


def is_newsletter(headers: Column) -> Column:
    return or_empty(F.try_element_at(headers, F.lit("list-unsubscribe"))) != ""


def rule_verdict(
    sender: Column,
    subject: Column,
    labels: Column,
    headers: Column,
    config: RuleConfig = RuleConfig(),
    trusted: Column | None = None,
) -> Column:
    """A verdict struct, or NULL: the mail has to be scored.

    Trusted senders skip every rule; an ignored label counts before the newsletter header.
    """

    def verdict(priority: str, label: str) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"),
            F.left(subject, F.lit(RULE_SUMMARY_CHARS)).alias("summary"),
            F.lit(label).alias("label"),
            F.lit("rule").alias("method"),
        )

    if trusted is None:
        trusted = is_trusted(sender, config.allowlist)
    return (
        F.when(trusted, F.lit(None).cast(VERDICT))
        .when(has_ignored_label(labels, config.ignore_labels), verdict("Ignore", "Ads"))
        .when(is_newsletter(headers), verdict("Not Necessary", "Newsletter"))
    )


def apply_rules(mail: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Add ``verdict`` to mail ``(from_addr, subject, labels, headers, ...)``."""
    return mail.withColumn(
        "verdict",
        rule_verdict(
            F.col("from_addr"), F.col("subject"), F.col("labels"), F.col("headers"), config
        ),
    )
