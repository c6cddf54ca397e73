"""Daily quota and failure breaker over a stream of calls.

The limits run on the clock of the calls as they arrive: each micro-batch folds its calls
in (ts, id) order, from the state the batch before has left. The fold is the distributed
one of ``operators.limits``; a keyed state function would hold a whole service in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.limits import BREAKER_MS, DAILY_QUOTA, FAILURE_LIMIT, apply_limits
from .tables import snapshot_before, write_batch

BREAKER_STATE = "service string, open_until bigint, fails bigint, last_fail bigint"
QUOTA_STATE = "service string, day bigint, used bigint"


def limit_calls(
    path: str,
    quota: int = DAILY_QUOTA,
    limit: int = FAILURE_LIMIT,
    ttl_ms: int = BREAKER_MS,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; writes ``calls``, ``breaker`` and ``quota`` below ``path``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        carry, used = limits_before(batch.sparkSession, path, batch_id)
        limited, states, now_used = apply_limits(batch, quota, limit, ttl_ms, carry, used)
        write_batch(limited, f"{path}/calls", batch_id)
        keep_limits(path, batch_id, carry, states, now_used)

    return run


def limits_before(spark: SparkSession, path: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Breaker states and the days' use that earlier micro-batches have left."""
    carry = snapshot_before(spark, f"{path}/breaker", batch_id, spark.createDataFrame([], BREAKER_STATE))
    used = snapshot_before(spark, f"{path}/quota", batch_id, spark.createDataFrame([], QUOTA_STATE))
    return carry, used


def keep_limits(
    path: str, batch_id: int, carry: DataFrame, states: DataFrame, used: DataFrame
) -> None:
    """Write the states of all services, and the use of every day: a late call counts on its own day."""
    idle = carry.join(states, "service", "left_anti")
    write_batch(states.unionByName(idle), f"{path}/breaker", batch_id)
    write_batch(used, f"{path}/quota", batch_id)
