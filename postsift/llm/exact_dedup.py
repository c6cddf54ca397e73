"""Exact dedup: a two-pass Bloom filter sends only possibly repeated hashes through a shuffle.

Pass one marks, in a bitmap of fixed size, every filter position that two or more rows hit.
Pass two probes it: a row at an unmarked position is the only one of its text and passes
straight through; the rest are grouped by their SHA-256. The filter can only err towards
"possibly repeated", so the result is exact at any filter size. Built-in functions only.

Defined cases: null text counts as empty (so all null and empty texts are one group); texts are
equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays; a
null id is smaller than any other; rows that repeat an id and text share ``kept``; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The filter's size. It is broadcast as bitmaps of 4 KB, so it never exceeds 16 MB, whatever the
# input; with far more rows than bits the filter fills up and more rows take the shuffle.
FILTER_BITS = 1 << 27


def text_hash(text: Column | str) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as lowercase hex."""
    return F.sha2(F.translate(whole(text), UPPER, LOWER).cast("binary"), 256)


def _position(sha: Column, bits: int) -> Column:
    # 60 bits of the digest; the filter's positions start at 1, as bitmap functions have it.
    return F.pmod(F.conv(F.substring(sha, 1, 15), 16, 10).cast("long"), F.lit(bits)) + 1


def repeated_positions(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """First pass: (``_bucket``, ``_bitmap``) of the positions that two or more rows hit."""
    hits = hashes.select(_position(F.col("text_sha256"), bits).alias("p")).groupBy("p").count()
    return (
        hits.where("count > 1")
        .groupBy(F.bitmap_bucket_number("p").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bitmap"))
    )


def with_maybe(rows: DataFrame, repeated: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Second pass: ``_maybe`` is false only where ``text_sha256`` surely occurs once."""
    placed = rows.withColumn("_p", _position(F.col("text_sha256"), bits))
    bit = F.bitmap_bit_position("_p")
    byte = F.expr("conv(hex(substring(_bitmap, cast(bitmap_bit_position(_p) DIV 8 AS int) + 1, 1)), 16, 10)")
    marked = F.getbit(byte.cast("long"), F.pmod(bit, F.lit(8)).cast("int")) == 1
    placed = placed.withColumn("_bucket", F.bitmap_bucket_number("_p"))
    return (
        placed.join(F.broadcast(repeated), "_bucket", "left")
        .withColumn("_maybe", F.coalesce(marked, F.lit(False)))
        .drop("_p", "_bucket", "_bitmap")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = stage(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"), text_hash(docs[text_col]).alias("text_sha256")
        ),
        "hashes",
    )
    probed = with_maybe(hashes, repeated_positions(hashes, filter_bits), filter_bits)
    single = probed.where("NOT _maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    maybe = probed.where("_maybe")
    # Written first: a skewed partition of a join is split only where both sides come from a shuffle.
    groups = stage(
        maybe.groupBy("text_sha256").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    repeated = maybe.join(groups, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(repeated)


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one ``exact_groups`` keeps.

    Texts at unmarked positions are not shuffled. Of rows that repeat the kept id and text one
    stays.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        text_hash(docs[text_col]).alias("text_sha256"),
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),  # whatever its columns are called
    )
    hashes = stage(rows.select("doc_id", "text_sha256"), "hashes")
    repeated = repeated_positions(hashes, filter_bits)
    winners = (
        with_maybe(hashes, repeated, filter_bits)
        .where("_maybe")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    probed = with_maybe(rows, repeated, filter_bits)
    single = probed.where("NOT _maybe").select("row.*")
    stays = (
        probed.where("_maybe")
        .join(winners, "text_sha256")
        .where(F.col("doc_id").eqNullSafe(F.col("_keep")))
    )
    alone = stays.where("_size = 1").select("row.*")
    copied = stays.where("_size > 1").dropDuplicates(["text_sha256"]).select("row.*")
    return single.unionByName(alone).unionByName(copied)
