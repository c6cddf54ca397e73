"""Deliver notifications from a stream: up to four tries each, outcomes written as a table.

The rows go out next to the data, one try after the other with waits between them. A micro-batch
writes its outcomes in one step; one that is run again after that sends nothing. One that is lost
before that is sent again: at least once, as a failed delivery also stays queued.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.digest import LAST_ATTEMPT, server_payload
from ..session import stage
from ..tables import files
from .tables import write_batch

Sink = Callable[[DataFrame, int], None]
Send = Callable[[str], bool]

# Fixed value: seconds before the second, third and fourth try.
WAITS = (1.0, 2.0, 4.0)


def deliver(
    notes: DataFrame,
    send: Send,
    keys: tuple[str, ...],
    waits: tuple[float, ...] = WAITS,
    now_ms: Callable[[], int] = lambda: time.time_ns() // 1_000_000,
) -> DataFrame:
    """``(*keys, delivered, tries, at)`` for rows with a ``body``.

    ``send(body)`` says whether a try went through; one that raises did not. It runs in the tasks, so
    it must be a function that can be sent there.
    """
    assert len(waits) == LAST_ATTEMPT

    def tried(body: str) -> tuple[bool, int]:
        for i, wait in enumerate((0.0, *waits)):
            if wait:
                time.sleep(wait)
            try:
                if send(body):
                    return True, i + 1
            except Exception:
                pass
        return False, len(waits) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [(*tried(body), now_ms()) for body in batch["body"]]
            yield batch.drop(columns="body").assign(
                delivered=[ok for ok, _, _ in told], tries=[n for _, n, _ in told], at=[t for _, _, t in told]
            )

    rows = notes.select(*keys, "body")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")
    # Written at once: a plan that is run twice, if only for a sort, would send twice.
    return stage(rows.mapInPandas(run, f"{ddl}, delivered boolean, tries int, at bigint"), "delivered")


def deliver_digests(
    path: str, send: Send, by: tuple[str, ...] = ("priority",), waits: tuple[float, ...] = WAITS
) -> Sink:
    """A ``foreachBatch`` function over digests of ``scheduled_digests``; writes outcomes to ``path``.

    An outcome names its queue, flush and chunk, so the folder can be read as events of
    ``scheduled_digests``, which marks what was delivered and queues the rest again.
    """
    keys = (*by, "flush_at", "chunk")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "_SUCCESS" in files.names(spark, f"{path}/batch_id={batch_id}"):
            return
        body = server_payload(F.col("title"), F.col("message"), F.col("priority_number"))
        write_batch(deliver(batch.withColumn("body", body), send, keys, waits), path, batch_id)

    return run
