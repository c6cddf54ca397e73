"""Rows of a stream in the order of their time, held back until a delay has passed.

A row is held until the latest time any row has stated is more than the delay past its own; then it
goes to the sink, in a micro-batch whose rows are all later than those of earlier ones. A row that
comes after its time has been let go is written to ``late`` and does not reach the sink. Held rows are
a table, rewritten by each micro-batch and bounded by what arrives within the delay; no key has to fit
in one task, and a retried micro-batch starts from the table before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch_path, stage_at
from .tables import read_all, read_batch, snapshot_before, write_batch

Sink = Callable[[DataFrame, int], None]
CLOCK = "latest bigint, let_go bigint"


def in_order(path: str, sink: Sink, delay_ms: int, ts: str = "ts") -> Sink:
    """A ``foreachBatch`` function that gives ``sink`` the rows up to ``delay_ms`` before the latest.

    Writes ``held``, ``late`` and ``clock`` below ``path``. Rows without a time are late.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = scratch_path(spark, "in-order")
        try:
            rows = stage_at(batch, f"{work}/rows")
            latest, let_go = _clock_before(spark, path, batch_id)
            stated = rows.agg(F.max(ts)).first()[0]
            latest = max((t for t in (latest, stated) if t is not None), default=None)
            upto = None if latest is None else latest - delay_ms
            _pass_on(spark, rows, batch_id, latest, let_go, upto)
        finally:
            remove(spark, work)

    def _pass_on(spark, rows, batch_id, latest, let_go, upto) -> None:
        gone = F.lit(False) if let_go is None else F.col(ts) <= let_go
        late = F.coalesce(gone, F.lit(True)) | F.col(ts).isNull()
        write_batch(rows.where(late), f"{path}/late", batch_id)
        pool = snapshot_before(spark, f"{path}/held", batch_id, rows.limit(0)).unionByName(rows.where(~late))
        if let_go is not None and upto is not None:
            upto = max(upto, let_go)
        due = F.lit(False) if upto is None else F.col(ts) <= upto
        write_batch(pool.where(~due), f"{path}/held", batch_id)
        write_batch(pool.where(due), f"{path}/let-go", batch_id)
        clock = spark.createDataFrame([(latest, upto)], CLOCK)
        write_batch(clock, f"{path}/clock", batch_id)
        sink(read_batch(spark, f"{path}/let-go", batch_id).select(*rows.columns), batch_id)

    return run


def _clock_before(spark: SparkSession, path: str, batch_id: int) -> tuple[int | None, int | None]:
    row = snapshot_before(spark, f"{path}/clock", batch_id, spark.createDataFrame([], CLOCK)).first()
    return (None, None) if row is None else (row.latest, row.let_go)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_all(spark, f"{path}/late")


def held_rows(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What micro-batch ``batch_id`` has left waiting."""
    return read_batch(spark, f"{path}/held", batch_id)
