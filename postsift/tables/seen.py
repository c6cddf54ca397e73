"""Ids that have been seen, as sorted runs with a Bloom filter each.

Runs are the files of a ``VersionedTable``: ids by hash bucket, sorted, merged in levels. Next to a
run stands its filter, 32 bits an id and three of them set, cut into bitmaps of 4 KB. A probe joins
the asked ids with the runs of their bucket, then with the bitmaps that hold their bits, and opens
only the files of runs that may hold one of them. Filters err towards "may hold", and the opened
files are joined exactly, so the answer is exact; all of it is built-in functions.

Ids are text and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .bitmaps import BLOCK
from .bitmaps import bit as _bit
from .versioned import File, Version, VersionedTable

BITS_PER_ID = 32
SEEN = "id string, seen_at bigint"


class SeenIds:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, fan: int = 4, keep: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = VersionedTable(spark, f"{self.path}/ids", SEEN, "id", buckets, fan, keep)

    def add(self, rows: DataFrame, batch_id: int | None = None) -> None:
        """Remember ``rows(id, seen_at)``, ids that are not in yet."""
        self._filter_new(self.table.insert(rows.select("id", "seen_at"), batch_id))

    def _filter_new(self, made: Version) -> None:
        have = {name.removeprefix("run=") for name in files.names(self.spark, f"{self.path}/filters")}
        for run in sorted({f.run for f in made.files} - have):
            self._filter([f for f in made.files if f.run == run], run)

    def _filter(self, own: list[File], run: str) -> None:
        """Write the filter of a run: (bucket, blocks, block, bits)."""
        rows = self.table.rows_of(own).select("id", self.table.bucket_of(F.col("id")).alias("bucket"))
        sizes = rows.groupBy("bucket").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
        set_bits = rows.join(F.broadcast(sizes), "bucket").select(  # a row a bucket
            "bucket", "blocks", F.explode(_places("id", F.col("blocks"))).alias("place")
        )
        bitmaps = set_bits.groupBy("bucket", "blocks", (F.col("place") / BLOCK).cast("int").alias("block")).agg(
            F.bitmap_construct_agg(F.col("place") % BLOCK).alias("bits")
        )
        bitmaps.write.mode("overwrite").parquet(f"{self.path}/filters/run={run}")

    def files_for(self, ids: DataFrame, before_batch: int | None = None) -> list[File]:
        """Files that may hold one of ``ids(id)``: a few names a bucket."""
        listed = self.table.current(before_batch).files
        runs = sorted({f.run for f in listed})
        if not runs:
            return []
        filters = self.spark.read.parquet(*[f"{self.path}/filters/run={run}" for run in runs])
        run_of = F.regexp_extract(F.col("_metadata.file_path"), "/run=([0-9a-f]+)/", 1)
        filters = filters.select("bucket", "blocks", "block", "bits", run_of.alias("run"))
        asked = ids.select("id", self.table.bucket_of(F.col("id")).alias("bucket")).distinct()
        # Every bucket of a run has at least one bitmap, which says how many blocks there are.
        sizes = filters.select("run", "bucket", "blocks").distinct()
        bits = asked.join(sizes, "bucket").select(
            "id", "run", "bucket", F.explode(F.array_distinct(_places("id", F.col("blocks")))).alias("place")
        )
        bits = bits.withColumn("block", (F.col("place") / BLOCK).cast("int"))
        wanted = bits.groupBy("id", "run", "bucket").agg(F.count(F.lit(1)).alias("n"))
        found = bits.join(filters.drop("blocks"), ["run", "bucket", "block"]).where(_bit(F.col("bits"), F.col("place") % BLOCK))
        found = found.groupBy("id", "run", "bucket").agg(F.count(F.lit(1)).alias("n"))
        may = found.join(wanted, ["id", "run", "bucket", "n"]).select("run", "bucket").distinct()
        hit = {(r.run, r.bucket) for r in may.collect()}  # at most a row a file
        return [f for f in listed if (f.run, f.bucket) in hit]

    def known(self, ids: DataFrame, before_batch: int | None = None) -> DataFrame:
        """Those of ``ids(id)`` that have been seen, each once."""
        opened = self.table.rows_of(self.files_for(ids, before_batch))
        return ids.select("id").distinct().join(opened.select("id"), "id", "left_semi")

    def unseen(self, rows: DataFrame, column: str = "id", before_batch: int | None = None) -> DataFrame:
        """``rows`` whose id has not been seen."""
        asked = rows.select(F.col(column).alias("id")).where("id IS NOT NULL")
        opened = self.table.rows_of(self.files_for(asked, before_batch)).select(F.col("id").alias("_seen"))
        return rows.join(opened, F.col(column) == F.col("_seen"), "left_anti")

    def forget_before(self, cutoff_ms: int, batch_id: int | None = None) -> None:
        """Drop ids seen before ``cutoff_ms``; buckets without one stay as they are."""
        old = F.col("seen_at") < cutoff_ms
        self._filter_new(self.table.rewrite_where(old, lambda rows: rows.where(~old), batch_id))

    def vacuum(self, keep: int | None = None) -> None:
        self.table.vacuum(keep)
        alive = {f.run for n in self.table.numbers() for f in self.table.version(n).files}
        for name in files.names(self.spark, f"{self.path}/filters"):
            if name.removeprefix("run=") not in alive:
                files.delete(self.spark, f"{self.path}/filters/{name}")


def _blocks(n: Column) -> Column:
    """Bitmaps for ``n`` ids."""
    return F.ceil(n * F.lit(BITS_PER_ID) / BLOCK).cast("int")


def _places(column: str, blocks: Column) -> Column:
    """Three bits of an id in a filter of ``blocks`` bitmaps, by hashes that the bucket does not use."""
    size = blocks.cast("bigint") * BLOCK
    return F.array(*[F.pmod(F.xxhash64(F.lit(salt), F.col(column)), size) for salt in (1, 2, 3)])
