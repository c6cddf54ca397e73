"""What the operators share: session settings, bounded slices of Arrow batches, staging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

# Python sees at most about this many bytes of a task's rows at a time (one longer row excepted).
SLICE_BYTES = 4 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """The library's settings with smaller Arrow batches: a batch holds whole texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16MB")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of at most ``limit`` bytes, however long single rows are."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            low, high = 1, batch.num_rows - start
            while low < high:
                middle = (low + high + 1) // 2
                if batch.slice(start, middle).nbytes <= limit:
                    low = middle
                else:
                    high = middle - 1
            yield batch.slice(start, low)
            start += low


def by_slice(
    df: DataFrame, run: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str
) -> DataFrame:
    """``run`` on every slice of ``df``; it returns the columns of ``schema``."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch_of(run(part), arrow)

    return df.mapInArrow(task, schema)


def by_task(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object]]],
    schema: str,
) -> DataFrame:
    """``run`` on the slices of each task, for what is built once a task or kept across slices."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(slices(batches)):
            yield batch_of(columns, arrow)

    return df.mapInArrow(task, schema)


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            v if isinstance(v, pa.Array) else pa.array(v, type=field.type)
            for field, v in ((f, columns[f.name]) for f in schema)
        ],
        schema=schema,
    )


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def whole(text: Column | str) -> Column:
    """A text as it stands; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are read, under fixed names; others may be called anything."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
