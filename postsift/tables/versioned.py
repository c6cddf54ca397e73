"""Tables of hash buckets that change in versions.

A table is a folder of Parquet files, each of which holds rows of one bucket of the key's hash, and
of manifests, one a version, that name the files of that version. Files never change: a change
writes new files for the buckets it touches and a manifest that names them and the untouched ones.
Readers hold a list of files, so they keep their version while others write; ``vacuum`` deletes what
no kept version names.

* ``insert`` only adds. A bucket's files are merged in levels: once it has ``fan`` files of a level,
  they become one of the next, so a row is rewritten once a level and a bucket never has more than
  ``fan`` files a level, however many inserts there were.
* ``update`` rewrites the buckets of the changed keys with any function from old rows and changes to
  new rows, such as the operators of ``operators.queue`` and ``operators.state``.
* ``rewrite_where`` rewrites the buckets that hold a row with some condition (retention, replay).

A change may carry the number of its micro-batch. It then starts from the last version of an earlier
micro-batch, so one that is retried replaces what its first try did. Without a
number it starts from the newest version. One writer at a time: a second one fails at the manifest,
which is put in place by a rename.

Keys must not be null. Numbers that go along with a version (a clock) live in its ``notes``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

BUCKETS = 16
FAN = 4
KEPT_VERSIONS = 8


@dataclass(frozen=True)
class File:
    path: str
    bucket: int
    level: int
    run: str  # the write it comes from


@dataclass(frozen=True)
class Version:
    number: int = 0
    batch_id: int = -1
    files: tuple[File, ...] = ()
    notes: dict[str, int | None] = field(default_factory=dict)

    def of_buckets(self, buckets: Iterable[int]) -> list[File]:
        wanted = set(buckets)
        return [f for f in self.files if f.bucket in wanted]


Change = Callable[[DataFrame, DataFrame], DataFrame]


class VersionedTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        key: str,
        buckets: int = BUCKETS,
        fan: int = FAN,
        keep: int = KEPT_VERSIONS,
    ):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.buckets, self.fan, self.keep = buckets, fan, keep

    # --- versions ---

    def numbers(self) -> list[int]:
        listed = files.names(self.spark, f"{self.path}/versions")
        return [int(n.removesuffix(".json")) for n in listed if n.endswith(".json") and not n.startswith(".")]

    def version(self, number: int) -> Version:
        told = json.loads(files.read_text(self.spark, f"{self.path}/versions/{number:012d}.json"))
        return Version(number, told["batch_id"], tuple(File(*f) for f in told["files"]), told["notes"])

    def current(self, before_batch: int | None = None) -> Version:
        """The newest version, or the newest that an earlier micro-batch has left."""
        for number in reversed(self.numbers()):
            found = self.version(number)
            if before_batch is None or found.batch_id < before_batch:
                return found
        return Version()

    def _commit(self, base: Version, new: Iterable[File], gone: Iterable[File], batch_id: int | None, notes: dict) -> Version:
        batch_id = base.batch_id if batch_id is None else batch_id
        dropped = set(gone)
        kept = tuple(f for f in base.files if f not in dropped) + tuple(new)
        number = max(self.numbers(), default=0) + 1
        made = Version(number, batch_id, kept, base.notes | notes)
        told = {"batch_id": batch_id, "notes": made.notes, "files": [[f.path, f.bucket, f.level, f.run] for f in kept]}
        files.create_text(self.spark, f"{self.path}/versions/{number:012d}.json", json.dumps(told))
        return made

    def vacuum(self, keep: int | None = None) -> int:
        """Forget all but the last versions, and the one a retry starts from; returns how many files went."""
        versions = [self.version(n) for n in self.numbers()]
        stay = versions[-(keep or self.keep) :]
        earlier = [v for v in versions if v.batch_id < versions[-1].batch_id]
        stay = stay + [v for v in earlier[-1:] if v not in stay]
        named = {f.path for v in stay for f in v.files}
        old = [v for v in versions if v not in stay]
        gone = {f.path for v in old for f in v.files} - named
        for path in gone:
            files.delete(self.spark, path)
        for v in old:
            files.delete(self.spark, f"{self.path}/versions/{v.number:012d}.json")
        return len(gone)

    # --- rows ---

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows_of(self, listed: Iterable[File]) -> DataFrame:
        paths = [f.path for f in listed]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before_batch: int | None = None) -> DataFrame:
        return self.rows_of(self.current(before_batch).files)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys: at most as many numbers as there are buckets."""
        found = keys.select(self.bucket_of(F.col(self.key)).alias("bucket")).distinct()
        return sorted(r.bucket for r in found.collect())

    def _write(self, rows: DataFrame, level: Callable[[int], int]) -> list[File]:
        """One folder a bucket; ``rebalance`` splits a large bucket over tasks and joins small ones."""
        run = uuid.uuid4().hex
        columns = self.rows_of(()).columns
        dealt = rows.select(*columns, self.bucket_of(F.col(self.key)).alias("_bucket"))
        folder = f"{self.path}/data/{run}"
        ordered = dealt.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key)
        ordered.write.partitionBy("_bucket").parquet(folder)
        out = []
        for path in files.data_files(self.spark, folder):
            bucket = int(path.rsplit("/", 2)[1].removeprefix("_bucket="))
            out.append(File(path, bucket, level(bucket), run))
        return out

    # --- changes ---

    def insert(self, rows: DataFrame, batch_id: int | None = None, notes: dict | None = None) -> Version:
        """Add rows whose keys the table does not have; ``rows`` must give the same rows when read again."""
        base = self.current(batch_id)
        absorbed: dict[int, tuple[int, list[File]]] = {b: self._due(base, b) for b in self.touched(rows)}
        merged = [f for _, listed in absorbed.values() for f in listed]
        new = self._write(rows.select(*self.rows_of(()).columns).unionByName(self.rows_of(merged)), lambda b: absorbed[b][0])
        return self._commit(base, new, merged, batch_id, notes or {})

    def _due(self, base: Version, bucket: int) -> tuple[int, list[File]]:
        """Level of the next file of a bucket, and the files that go into it."""
        own, level, absorbed = base.of_buckets([bucket]), 0, []
        while len({f.run for f in own if f.level == level}) + 1 > self.fan:
            absorbed += [f for f in own if f.level == level]
            level += 1
        return level, absorbed

    def update(
        self, changes: DataFrame, change: Change, batch_id: int | None = None, notes: dict | None = None
    ) -> Version:
        """New rows of the buckets that ``changes`` has keys of: ``change(old rows, changes)``."""
        base = self.current(batch_id)
        buckets = self.touched(changes)
        old = base.of_buckets(buckets)
        new = self._write(change(self.rows_of(old), changes), lambda b: 0)
        return self._commit(base, new, old, batch_id, notes or {})

    def rewrite_where(
        self, condition: Column, change: Callable[[DataFrame], DataFrame], batch_id: int | None = None
    ) -> Version:
        """``change`` on the buckets with a row that meets ``condition``; the others stay as they are."""
        base = self.current(batch_id)
        hit = self.touched(self.rows_of(base.files).where(condition))
        old = base.of_buckets(hit)
        new = self._write(change(self.rows_of(old)), lambda b: 0) if old else []
        return self._commit(base, new, old, batch_id, {})
