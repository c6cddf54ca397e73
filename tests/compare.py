"""Run registered queries next to their SQL twins: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def normalised(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """What differs, or None."""
    want = con.sql(sql)
    got_rows, want_rows = [tuple(r) for r in df.collect()], want.fetchall()
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} vs {sorted(want.columns)}"
    got, expected = normalised(df.columns, got_rows), normalised(want.columns, want_rows)
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}"
    bad = [(g, w) for g, w in zip(got, expected, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connect(sf_dir)
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                verdict = difference(df, oracles[name], con) or f"ok {df.count()}"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            verdict = f"ERROR {str(error)[:700]}"
        failed += not verdict.startswith(("ok", "rows"))
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict[:1200]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
