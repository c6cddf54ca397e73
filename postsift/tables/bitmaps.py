"""Bitmaps of 4 KB, and a filter of them that is small enough for every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 15  # bits of a bitmap
# A filter has at most as many bitmaps: 2**27 bits, 16 MB.
FILTER_BLOCKS = 1 << 12


def bit(bits: Column, place: Column) -> Column:
    """Whether bit ``place`` of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def maybe_in(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``on`` is not among ``keys``; none that is goes.

    One bit a key in a filter of fixed size, broadcast whatever the number of keys: rows are tested where they are
    read, ahead of an exchange. With ``n`` keys about ``n / 2**27`` of the other rows stay, so an exact join has
    to follow, and from some 10**8 keys on little is held back.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BLOCKS * BLOCK))
    block = (F.col("_place") / BLOCK).cast("int").alias("_block")
    within = F.col("_place") % BLOCK
    placed = keys.select(place.alias("_place"))
    filters = placed.groupBy(block).agg(F.bitmap_construct_agg(within).alias("_bits"))
    tested = rows.withColumn("_place", place).withColumn("_block", block).join(F.broadcast(filters), "_block")
    return tested.where(bit(F.col("_bits"), within)).select(*rows.columns)
