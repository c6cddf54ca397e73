"""Label ids, created where a mailbox has no label of that name yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routing import LABEL_PREFIX


def get_or_create_labels(
    wanted: DataFrame, known: DataFrame, scope: tuple[str, ...] = ("account",)
) -> DataFrame:
    """Known labels plus one row per missing one.

    ``wanted(*scope, label)``, ``known(*scope, name, label_id)`` with the full name. The
    distinct is partly done before its shuffle, so a label on a third of all mail is cheap.
    """
    names = wanted.select(
        *scope, F.concat(F.lit(LABEL_PREFIX), F.col("label")).alias("name")
    ).distinct()
    key = F.concat_ws("\0", *scope, "name")
    created = names.join(known, [*scope, "name"], "left_anti").select(
        *scope, "name", F.concat(F.lit("Label_"), F.left(F.sha2(key, 256), F.lit(16))).alias("label_id")
    )
    return known.select(*scope, "name", "label_id").unionByName(created)


def with_label_id(
    mail: DataFrame, labels: DataFrame, scope: tuple[str, ...] = ("account",)
) -> DataFrame:
    """Add ``label_id`` to mail ``(*scope, label, ...)``."""
    named = mail.withColumn("name", F.concat(F.lit(LABEL_PREFIX), F.col("label")))
    return named.join(labels, [*scope, "name"], "left").drop("name")
