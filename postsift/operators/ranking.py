"""Position of every row in its queue, for queues of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# monotonically_increasing_id: partition number above, row number in the low 33 bits.
ROW_BITS = 33
# Side tables of narrow rows are broadcast up to this many rows.
FEW_ROWS = 500_000


def ordered_runs(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Range-partition by ``by, order`` and write once, with ``_part`` and ``_row``.

    Range partitioning splits a key that holds a third of all rows over many tasks, which
    a window over that key would not. The bounds are sampled, so the numbered rows are
    written and read back: every later pass sees the same partitions.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    numbered = ranged.withColumn("_row", F.monotonically_increasing_id())
    return stage(numbered.withColumn("_part", F.shiftright("_row", ROW_BITS).cast("int")), name)


def positions(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row among rows with equal ``by``.

    Position = rows of the key in earlier partitions + offset in the own one. The window
    runs over one row per (key, partition), so over at most as many rows per key as there
    are partitions. Offsets are staged and counted: a counted few are broadcast, so that the
    rows stay where they are; more than that meet the rows by an ordinary join.
    """
    runs = ordered_runs(df, by, order, "positions")
    sizes = runs.groupBy(*by, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    before = (
        Window.partitionBy(*by)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_by_part"),
        "_first",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    same = _same(by) & (F.col("_part") == F.col("_by_part"))
    return runs.join(broadcast_if_few(offsets, "offsets"), same).select(
        *df.columns, (F.col("_offset") + F.col("_row") - F.col("_first") + 1).alias(name)
    )


def broadcast_if_few(df: DataFrame, name: str) -> DataFrame:
    """Stage a table of a few numbers a row, count it, and mark it for broadcast if it is small."""
    staged = stage(df, name)
    return F.broadcast(staged) if staged.count() <= FEW_ROWS else staged


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return same
