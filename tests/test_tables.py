"""Versioned tables and the index of seen ids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from postsift.operators import queue, state
from postsift.sources import feed
from postsift.sources.tables import PENDING, STATE
from postsift.tables import bitmaps, files
from postsift.tables.seen import SeenIds
from postsift.tables.versioned import VersionedTable

ROW = "key string, value string, updated_at bigint"


def changes(spark, *items):
    return spark.createDataFrame(list(items), STATE)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), STATE, "key", buckets=4, fan=2, keep=3)


def held(df):
    return {r.key: r.value for r in df.collect()}


def test_inserts_merge_in_levels(spark, table):
    want, most = {}, 0
    for i in range(14):
        batch = [(f"k{i}-{j}", str(i), i) for j in range(6)]
        made = table.insert(changes(spark, *batch))
        want |= {k: v for k, v, _ in batch}
        most = max(most, max(sum(f.bucket == b for f in made.files) for b in range(4)))
        for b in range(4):
            levels = [f.level for f in made.of_buckets([b])]
            assert max(map(levels.count, levels), default=0) <= table.fan
    # 14 inserts at a fan of 2: levels 0, 1 and 2, two files each.
    assert held(table.read()) == want and most <= 6 and len(table.read().inputFiles()) <= 24


def test_updates_rewrite_touched_buckets_only(spark, table):
    table.insert(changes(spark, *[(f"k{i}", "old", 1) for i in range(400)]))
    before = table.current()
    change = changes(spark, ("k7", "new", 2), ("k7", "late", 1), ("k8", "older", 0))
    after = table.update(change, state.upsert)
    hit = set(table.touched(change))
    assert 0 < len(hit) < 4
    assert {f for f in before.files if f.bucket not in hit} == {f for f in after.files if f.bucket not in hit}
    got = held(table.read())
    assert got.pop("k7") == "new" and set(got.values()) == {"old"} and len(got) == 399


def test_readers_keep_their_version(spark, table):
    table.insert(changes(spark, ("a", "1", 1), ("b", "1", 1)))
    reader = table.read()
    for i in range(2, 4):
        table.update(changes(spark, ("a", str(i), i)), state.upsert)
    table.vacuum()
    assert held(reader) == {"a": "1", "b": "1"} and held(table.read()) == {"a": "3", "b": "1"}
    for i in range(4, 9):
        table.update(changes(spark, ("a", str(i), i)), state.upsert)
    table.vacuum()
    assert len(table.numbers()) <= 4 and held(table.read()) == {"a": "8", "b": "1"}
    on_disk = files.data_files(spark, f"{table.path}/data")
    assert len(on_disk) <= 2 * 4


def test_a_retried_micro_batch_replaces_its_first_try(spark, table):
    table.update(changes(spark, ("a", "1", 1)), state.upsert, batch_id=0)
    table.update(changes(spark, ("a", "wrong", 9), ("b", "wrong", 9)), state.upsert, batch_id=1)
    table.update(changes(spark, ("a", "2", 2)), state.upsert, batch_id=1)
    assert held(table.read()) == {"a": "2"} and held(table.read(before_batch=1)) == {"a": "1"}
    table.vacuum(1)  # what a retry starts from stays
    assert held(table.read(before_batch=1)) == {"a": "1"}


def test_an_empty_change_and_an_empty_table(spark, table):
    assert held(table.read()) == {} and table.current().number == 0
    table.update(changes(spark).limit(0), state.upsert)
    table.insert(changes(spark).limit(0))
    table.rewrite_where(F.lit(True), lambda rows: rows)
    assert held(table.read()) == {} and table.current().number == 3


def test_two_writers_cannot_make_the_same_version(spark, tmp_path):
    files.create_text(spark, f"{tmp_path}/v/1.json", "one")
    with pytest.raises(FileExistsError):
        files.create_text(spark, f"{tmp_path}/v/1.json", "two")
    assert files.read_text(spark, f"{tmp_path}/v/1.json") == "one" and files.names(spark, f"{tmp_path}/v") == ["1.json"]


def test_the_queue_as_a_versioned_table(spark, tmp_path):
    pending = spark.createDataFrame(
        [(f"e{i}", "a@b", "s", "t", ["High", "Low"][i % 2], i, i * 10 if i % 3 else None) for i in range(30)], PENDING
    )
    table = VersionedTable(spark, f"{tmp_path}/q", PENDING, "id", buckets=4)
    table.insert(pending)
    again = pending.withColumn("subject", F.lit("other"))  # known ids stay as they are
    table.update(again, lambda old, new: queue.insert_ignore(old, new, "id", ["received_at"]))
    ids = pending.where("priority = 'Low'").select("id")
    table.update(ids, lambda old, new: queue.mark_sent(old, new, 500))
    table.rewrite_where(queue.needs_replay(28), lambda rows: queue.replay(rows, 28))
    table.rewrite_where(F.col("sent_at") < 500, lambda rows: queue.retain_pending(rows, 500, 0))
    want = queue.retain_pending(queue.replay(queue.mark_sent(pending, ids, 500), 28), 500, 0)
    assert rows(table.read(), "id") == rows(want, "id")


def ids_of(spark, names):
    return spark.createDataFrame([(n, 5) for n in names], "id string, seen_at bigint")


@pytest.fixture
def seen(spark, tmp_path):
    return SeenIds(spark, str(tmp_path / "seen"), buckets=4, fan=2)


def test_seen_ids_open_only_files_that_may_hold_them(spark, seen):
    assert seen.files_for(ids_of(spark, ["x"])) == []
    for i in range(6):
        seen.add(ids_of(spark, [f"m{i}-{j}" for j in range(50)]))
    everything = seen.table.current().files
    assert len(everything) >= 8
    asked = ids_of(spark, ["m0-3", "nowhere", "m5-49", "m5-49"])
    opened = seen.files_for(asked)
    assert 1 <= len(opened) <= 3
    assert rows(seen.known(asked), "id") == [("m0-3",), ("m5-49",)]
    strangers = ids_of(spark, [f"z{j}" for j in range(300)])
    assert len(seen.files_for(strangers)) <= 1  # three bits of 32 an id: about one in a thousand errs
    mixed = strangers.unionByName(ids_of(spark, ["m2-2"])).withColumnRenamed("id", "mail")
    assert seen.unseen(mixed, "mail").count() == 300
    null = spark.createDataFrame([(None,), ("m1-1",)], "id string")
    assert [r.id for r in seen.unseen(null).collect()] == [None]


def test_seen_ids_are_exact_with_full_filters(spark, seen, monkeypatch):
    seen.add(ids_of(spark, [f"m{j}" for j in range(40)]))
    monkeypatch.setattr("postsift.tables.seen._bit", lambda bits, place: F.lit(True))
    asked = ids_of(spark, ["m1", "a", "b", "c", "d", "e"])
    assert len(seen.files_for(asked)) > 1 and rows(seen.known(asked)) == [("m1",)]


def test_seen_ids_per_micro_batch_and_forgotten(spark, seen):
    for batch in range(3):
        rows_of_batch = spark.createDataFrame([(f"m{batch}", batch)], "id string, seen_at bigint")
        seen.add(rows_of_batch, batch)
        seen.add(rows_of_batch, batch)  # a retry
    asked = ids_of(spark, ["m0", "m1", "m2"])
    assert rows(seen.known(asked, before_batch=2), "id") == [("m0",), ("m1",)]
    assert seen.table.read().count() == 3
    seen.forget_before(2, 3)
    seen.vacuum(1)
    assert rows(seen.known(asked), "id") == [("m2",)]
    alive = {f"run={f.run}" for n in seen.table.numbers() for f in seen.table.version(n).files}
    assert set(files.names(spark, f"{seen.path}/filters")) == alive


def test_feed_ids_against_an_index(spark, seen):
    found = spark.createDataFrame([("a", "m1"), ("a", "m1"), ("a", "m2"), ("b", "m1"), ("b", "m9")], "account string, message_id string")
    seen.add(ids_of(spark, ["m2", "m8"]))
    plain = feed.unseen(found, spark.createDataFrame([("m2",), ("m8",)], "message_id string"))
    assert rows(feed.unseen(found, seen), "account", "message_id") == rows(plain.select("account", "message_id"), "account", "message_id")


def test_bit_filter_holds_back_what_is_not_asked(spark, monkeypatch):
    stored = spark.range(3000).select((F.col("id") % 50).cast("string").alias("m"), F.col("id").alias("a"), F.lit("x").alias("data"))
    stored = stored.unionByName(spark.createDataFrame([(None, 1, "n")], stored.schema))
    asked = stored.where("a % 10 = 0 OR m IS NULL").select("m", "a")
    held = bitmaps.maybe_in(stored, asked, ["m", "a"])
    assert held.columns == stored.columns and held.join(asked, ["m", "a"]).count() == 300
    assert 301 <= held.count() < 310 and held.where("m IS NULL").count() == 1
    assert bitmaps.maybe_in(stored, asked.limit(0), ["m", "a"]).count() == 0
    # A full filter lets everything pass and loses nothing.
    monkeypatch.setattr(bitmaps, "FILTER_BLOCKS", 1)
    monkeypatch.setattr(bitmaps, "BLOCK", 8)
    assert bitmaps.maybe_in(stored, asked, ["m", "a"]).count() == 3001
