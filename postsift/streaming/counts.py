"""Statistics that follow the tables a stream writes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Kept(Protocol):
    def refresh(self) -> object: ...


def with_counts(
    sink: Callable[[DataFrame, int], None], kept: Callable[[SparkSession], list[Kept]]
) -> Callable[[DataFrame, int], None]:
    """``sink``, then bring the counts on its tables up to date.

    A retried micro-batch puts other files in place of those of its first try; the counts take back the one
    and add the other, since they go by what two versions do not share.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        for counts in kept(batch.sparkSession):
            counts.refresh()

    return run
