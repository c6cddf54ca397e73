"""Counts of a versioned table that follow its changes.

A version names its files, and files never change, so what happened between two versions is what the
files say that they do not share: rows of new files count one, rows of files that went count minus
one. Rows that were only moved (a merge, an untouched row of a rewritten bucket) cancel out. This
holds for any mix of inserts, marks, replays, retention and retried micro-batches, however many
versions lie in between, and reads the touched buckets alone.

The counts are a versioned table themselves, with the version of the source they stand at in its
notes, so a refresh that dies is done again from where the last one ended. If that version of the
source has been vacuumed away, the refresh counts the whole table anew. Counts can be counted on
(hours from instants): give the column to add up as ``weight``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove, scratch_path, stage_at
from .versioned import BUCKETS, File, Version, VersionedTable

SOURCE = "source"


class KeptCounts:
    """``dims`` with how many rows that meet ``where`` have them, as ``n``.

    Rows are in buckets by the hash of ``together`` (all of ``dims`` if not given), so a reader who
    wants one value of it opens one bucket. Nulls in ``dims`` are values as others are.
    """

    def __init__(
        self,
        table: VersionedTable,
        path: str,
        dims: dict[str, Column],
        where: Column | None = None,
        weight: str | None = None,
        together: tuple[str, ...] | None = None,
        buckets: int = BUCKETS,
    ):
        self.table, self.path, self.dims = table, path, dims
        self.where = F.lit(True) if where is None else where
        self.weight = F.lit(1) if weight is None else F.col(weight)
        self.together = together or tuple(dims)
        fields = table.rows_of(()).select(*self._named()).schema.fields
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        self.kept = VersionedTable(table.spark, path, f"key string, {types}, n bigint", "key", buckets)

    def _named(self) -> list[Column]:
        return [value.alias(name) for name, value in self.dims.items()]

    def key_of(self, *values: Column) -> Column:
        """The bucket key of some values of ``together``."""
        return F.to_json(F.struct(*[v.alias(n) for n, v in zip(self.together, values, strict=True)]))

    def refresh(self) -> Version:
        """Bring the counts to the newest version of the table."""
        now, kept = self.table.current(), self.kept.current()
        if kept.notes.get(SOURCE) == now.number:
            return kept
        since = self.stands_at()
        if since is None:
            counted = self._counted(now.files, 1).unionByName(self._minus(kept))
        else:
            new, gone = set(now.files) - set(since.files), set(since.files) - set(now.files)
            counted = self._counted(new, 1).unionByName(self._counted(gone, -1))
        work = scratch_path(self.table.spark, "counts")
        try:
            changes = stage_at(self._summed(counted), work)
            made = self.kept.update(changes, self._added, notes={SOURCE: now.number})
        finally:
            remove(self.table.spark, work)
        self.kept.vacuum()
        return made

    def stands_at(self) -> Version | None:
        """The version of the table that the counts tell of, if it is still there."""
        number = self.kept.current().notes.get(SOURCE)
        return self.table.version(number) if number in self.table.numbers() else None

    def _counted(self, listed: Iterable[File], sign: int) -> DataFrame:
        rows = self.table.rows_of(sorted(listed, key=lambda f: f.path)).where(self.where)
        named = rows.select(*self._named(), (self.weight * F.lit(sign)).cast("bigint").alias("n"))
        return named.select(self.key_of(*map(F.col, self.together)).alias("key"), *self.dims, "n")

    def _minus(self, kept: Version) -> DataFrame:
        return self.kept.rows_of(kept.files).withColumn("n", -F.col("n"))

    def _summed(self, counted: DataFrame) -> DataFrame:
        """One row a combination, added up in the tasks before the shuffle; those at zero go."""
        summed = counted.groupBy("key", *self.dims).agg(F.sum("n").alias("n"))
        return summed.where(F.col("n") != 0)

    def _added(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        return self._summed(old.unionByName(changes))

    def read(self) -> DataFrame:
        """``(dims, n)`` as of the last refresh."""
        return self.kept.read().select(*self.dims, "n")

    def read_one(self, *values: Column, version: Version | None = None) -> DataFrame:
        """The same for one value of ``together``, given as literals: one bucket is opened.

        ``version`` is one of the counts, for readers of several tables that have to agree.
        """
        only = self.kept.spark.range(1).select(self.key_of(*values).alias("key"))
        files = (version or self.kept.current()).of_buckets(self.kept.touched(only))
        wanted = self.kept.rows_of(files).where(F.col("key") == self.key_of(*values))
        return wanted.select(*self.dims, "n")
