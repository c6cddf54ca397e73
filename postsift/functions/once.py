"""Keep costly values from being computed again by every use of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) ``columns``, computed once per row.

    Catalyst pushes a filter on a computed column below its projection and evaluates the
    whole expression a second time, and it cannot run a Python function there at all.
    Generating one row from one struct keeps the filter above.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
