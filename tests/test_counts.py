"""Counts that follow a versioned table, against counting anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from postsift.operators import queue, stats
from postsift.operators.kept_stats import KeptDaily, KeptPending, KeptProcessed
from postsift.sources.tables import PENDING, PROCESSED_MESSAGES
from postsift.streaming.counts import with_counts
from postsift.tables.counts import KeptCounts
from postsift.tables.versioned import VersionedTable

HOUR, DAY = 3_600_000, 86_400_000
NOW = 20_000 * DAY + 7 * HOUR + 1234


def mails(spark, *items):
    return spark.createDataFrame([(i, "f", "s", "m", p, at, sent) for i, p, at, sent in items], PENDING)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "q"), PENDING, "id", buckets=4, fan=2)


def test_any_sequence_of_changes(spark, table, tmp_path):
    kept, dice = KeptPending(table, str(tmp_path / "c")), random.Random(7)
    known = 0
    for step in range(9):
        kind = "insert" if step == 0 else dice.choice(["insert", "mark", "replay", "retain"])
        if kind == "insert":
            new = [(f"m{known + i}", dice.choice(["High", "Low", None]), dice.randrange(10), None) for i in range(20)]
            known += 20
            table.insert(mails(spark, *new))
        elif kind == "mark":
            ids = spark.createDataFrame([(f"m{dice.randrange(known)}",) for _ in range(6)], "id string")
            table.update(ids, lambda old, hit, at=step: queue.mark_sent(old, hit, at))
        elif kind == "replay":
            table.rewrite_where(queue.needs_replay(8), lambda old: queue.replay(old, 8))
        else:
            gone = F.col("sent_at") < step - 3
            table.rewrite_where(gone, lambda old, at=step: queue.retain_pending(old, at, 3))
        if step % 3 != 1:  # a refresh may have several versions to catch up with
            kept.refresh()
            assert rows(kept.by_priority(), "priority") == rows(stats.pending_counts(table.read()), "priority")


def test_a_refresh_reads_changed_files_only(spark, table, tmp_path, monkeypatch):
    kept = KeptPending(table, str(tmp_path / "c"))
    table.insert(mails(spark, *[(f"m{i}", "High", i, None) for i in range(80)]))
    kept.refresh()
    before = table.current()
    ids = spark.createDataFrame([("m3",)], "id string")
    after = table.update(ids, lambda old, hit: queue.mark_sent(old, hit, 5))
    read, rows_of = [], VersionedTable.rows_of
    monkeypatch.setattr(
        VersionedTable, "rows_of", lambda self, files: read.extend(files if self is table else ()) or rows_of(self, files)
    )
    kept.refresh()
    assert set(read) == set(before.files) ^ set(after.files) and len(set(read)) < len(before.files)
    read.clear()
    stands = kept.counts.kept.current().number
    kept.refresh()
    assert read == [] and kept.counts.kept.current().number == stands
    assert dict(rows(kept.by_priority()))["High"] == 79


def test_counts_anew_once_the_version_is_gone(spark, table, tmp_path):
    kept = KeptPending(table, str(tmp_path / "c"))
    table.insert(mails(spark, ("a", "High", 1, None), ("b", "Odd", 1, None)))
    kept.refresh()
    ids = spark.createDataFrame([("b",)], "id string")
    table.update(ids, lambda old, hit: queue.mark_sent(old, hit, 5))
    for i in range(3):
        table.insert(mails(spark, (f"x{i}", "Low", 1, None)))
    table.vacuum(keep=1)
    assert kept.counts.stands_at() is None
    kept.refresh()
    assert {k: n for k, n in rows(kept.by_priority()) if n} == {"High": 1, "Low": 3}
    assert kept.counts.read().where("n = 0").count() == 0


def test_a_refresh_that_dies_is_done_again(spark, table, tmp_path, monkeypatch):
    kept = KeptPending(table, str(tmp_path / "c"))
    table.insert(mails(spark, ("a", "High", 1, None)))
    with monkeypatch.context() as patched:
        patched.setattr(VersionedTable, "_commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.refresh()
    kept.refresh()
    assert dict(rows(kept.by_priority()))["High"] == 1


def test_a_retried_micro_batch_counts_once(spark, table, tmp_path):
    kept = KeptPending(table, str(tmp_path / "c"))
    sink = with_counts(lambda batch, batch_id: table.insert(batch, batch_id) and None, lambda spark: [kept])
    sink(mails(spark, ("a", "High", 1, None)), 0)
    sink(mails(spark, ("b", "High", 1, None), ("c", "Low", 1, None)), 1)
    sink(mails(spark, ("b", "High", 1, None)), 1)
    assert {k: n for k, n in rows(kept.by_priority()) if n} == {"High": 2}


def test_empty_table(spark, table, tmp_path):
    kept = KeptPending(table, str(tmp_path / "c"))
    kept.refresh()
    table.insert(mails(spark))
    kept.refresh()
    assert [n for _, n in rows(kept.by_priority())] == [0, 0, 0, 0]
    done = VersionedTable(spark, str(tmp_path / "p"), PROCESSED_MESSAGES, "message_id")
    asked = KeptProcessed(done, str(tmp_path / "pc"))
    assert tuple(asked.at(NOW).first()) == (0, 0)
    asked.refresh()
    assert tuple(asked.at(NOW).first()) == (0, 0)


def test_mailboxes_apart(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "q"), f"box string, {PENDING}", "id")
    df = mails(spark, ("a", "High", 1, None), ("b", "High", 1, None), ("c", "Low", 1, 4))
    table.insert(df.withColumn("box", F.when(F.col("id") == "a", "x")))
    kept = KeptPending(table, str(tmp_path / "c"), ("box",))
    kept.refresh()
    assert set(rows(kept.counts.read())) == {(None, "High", 1), ("x", "High", 1)}
    assert dict(rows(kept.by_priority()))["High"] == 2


def test_day_and_month_at_their_bounds(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "p"), PROCESSED_MESSAGES, "message_id", buckets=4)
    kept = KeptProcessed(table, str(tmp_path / "c"))
    full = 20_000 * DAY + 8 * HOUR
    asked = [NOW, NOW - 1, full, full + 1, full - 1, 19_997 * DAY]  # 2024-10-04, and -01
    month = 19_997 * DAY
    edges = [t + d for t in (NOW, NOW - DAY, full - DAY, full, month, month - DAY) for d in (-1, 0, 1)]
    items = [(f"p{i}", at) for i, at in enumerate(edges)] + [("none", None), ("old", -5)]
    done = spark.createDataFrame(items, PROCESSED_MESSAGES)

    def same():
        kept.refresh()
        for now in asked:
            assert tuple(kept.at(now).first()) == tuple(stats.processed_counts(table.read(), now).first())

    table.insert(done.where("message_id < 'p3'"))
    same()
    table.insert(done.where("message_id >= 'p3'"))
    same()
    # A reader between the two levels sees both as of one version.
    before = tuple(kept.at(NOW).first())
    table.insert(spark.createDataFrame([("more", NOW - DAY + 1), ("late", NOW)], PROCESSED_MESSAGES))
    kept.instants.refresh()
    assert tuple(kept.at(NOW).first()) == before
    table.rewrite_where(F.col("processed_at") < month, lambda held: queue.retain_processed(held, month, 0))
    same()


def test_one_hour_is_one_bucket(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id string, at bigint", "id")
    counts = KeptCounts(
        table, str(tmp_path / "c"), {"hour": F.floor(F.col("at") / 10).cast("bigint"), "at": F.col("at")}, together=("hour",)
    )
    table.insert(spark.createDataFrame([(str(i), i // 2) for i in range(200)], "id string, at bigint"))
    counts.refresh()
    one = counts.read_one(F.lit(3).cast("bigint"))
    assert rows(one, "at") == [(3, at, 2) for at in range(30, 40)]
    assert len(one.inputFiles()) < len(counts.read().inputFiles())


def test_daily_calls(spark, tmp_path):
    schema = "message_id string, ts bigint, method string"
    table = VersionedTable(spark, str(tmp_path / "r"), schema, "message_id")
    kept = KeptDaily(table, str(tmp_path / "c"))
    items = [("a", 5, "openrouter"), ("b", DAY, "workers-ai"), ("c", DAY + 1, "openrouter"), ("d", DAY, "fallback"), ("e", DAY, None)]
    table.insert(spark.createDataFrame(items, schema))
    kept.refresh()
    assert rows(kept.by_day(), "day") == rows(stats.daily_classifications(table.read()), "day")
    assert rows(kept.by_day(), "day") == [("1970-01-01", 1), ("1970-01-02", 2)]
