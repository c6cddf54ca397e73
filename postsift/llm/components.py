"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, scratch_path, stage_at


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges`` (a long, b long) to (node, root): root is the least node reachable.

    Large stars hang every greater neighbour of a node on its least neighbour, small stars the
    lesser ones; both keep what is connected, and after O(log² n) rounds every node hangs on its
    root. A node's minimum is aggregated before the shuffle, written, and joined back: both sides of
    the join then come from a shuffle of their own, so that a node with very many neighbours is split. Each round is a written table; the one before is deleted.
    Nodes without an edge to another node are not returned.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    current = stage_at(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        path,
    )
    before = None
    for _ in range(most_rounds):
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
        ).first()
        if (state["n"], state["x"]) == before or not state["n"]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (state["n"], state["x"])
        following = scratch_path(spark, "edges")
        work = scratch_path(spark, "stars")
        hung = stage_at(_large_star(current, f"{work}/least"), f"{work}/hung")
        contracted = stage_at(_small_star(hung, f"{work}/least-again"), following)
        remove(spark, work)
        remove(spark, path)
        current, path = contracted, following
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _large_star(edges: DataFrame, work: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stage_at(least, work)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, work: str) -> DataFrame:
    least = stage_at(edges.groupBy("u").agg(F.min("v").alias("m")), work)
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
