from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from postsift.functions.clock import DAY_MS, HOUR_MS
from postsift.functions.text import MESSAGE_LINK
from postsift.operators import digest, labels, queue, ranking, routing, state, stats
from postsift.sources.tables import PENDING, PROCESSED_HISTORY, STATE, read_table

NOW = 1706659200000


def pending(spark, *given):
    """Rows (id, priority, received_at, sent_at, from_addr, summary), the last ones optional."""
    full = []
    for row in given:
        rid, priority, received, sent, sender, summary = (*row, *[None] * (6 - len(row)))
        full.append((rid, sender or "alice@example.com", "Hello", summary or f"s {rid}", priority, received, sent))
    return spark.createDataFrame(full, PENDING)


def classified(spark, *given):
    verdict = "struct<priority:string,summary:string,label:string,method:string>"
    return spark.createDataFrame(
        [(i, "a@x.io", "Subj", (p, "sum", "Work", "openrouter"), t) for i, p, t in given],
        f"id string, from_addr string, subject string, verdict {verdict}, received_at bigint",
    )


def test_enqueue_then_read_by_priority(spark):
    new = classified(spark, ("e1", "High", 1), ("e2", "Low", 2), ("c", "Critical", 3), ("i", "Ignore", 4), ("e1", "Low", 9))
    table = queue.enqueue(pending(spark, ("e2", "High", 0)), new)
    assert rows(table.select("id", "priority", "received_at"), "id") == [("e1", "High", 1), ("e2", "High", 0)]
    assert rows(queue.oldest_unsent(table).select("id", "pos"), "pos") == [("e2", 1), ("e1", 2)]
    assert queue.enqueue(table, new).count() == 2


def test_mark_sent(spark):
    table = pending(spark, ("e3", "High", 1), ("e4", "High", 2), ("e5", "High", 3, 7))
    ids = spark.createDataFrame([("e3",), ("e5",), ("e3",), ("gone",)], "id string")
    marked = queue.mark_sent(table, ids, NOW)
    assert rows(marked.select("id", "sent_at"), "id") == [("e3", NOW), ("e4", None), ("e5", NOW)]
    assert marked.columns == table.columns
    assert rows(queue.mark_sent(table, ids.limit(0), NOW), "id") == rows(table, "id")


def test_retention(spark):
    table = pending(
        spark,
        ("old", "Low", 0, NOW - 25 * HOUR_MS),
        ("edge", "Low", 0, NOW - 24 * HOUR_MS),
        ("unsent", "Low", 0),
    )
    assert rows(queue.retain_pending(table, NOW).select("id"), "id") == [("edge",), ("unsent",)]
    seen = spark.createDataFrame([("a", NOW - 2 * DAY_MS), ("b", NOW - 2 * DAY_MS - 1)], PROCESSED_HISTORY)
    assert rows(queue.retain_processed(seen, NOW).select("history_id")) == [("a",)]


def test_replay(spark):
    table = pending(spark, ("a", "Low", 10), ("b", "Low", 1, 10), ("c", "Low", 1, 9), ("d", "Low", 1), ("e", "Low", 10, 11))
    assert rows(queue.replay(table, 10).select("id", "sent_at"), "id") == [
        ("a", None), ("b", None), ("c", 9), ("d", None), ("e", None),
    ]
    assert queue.replayed_rows(table, 10).first().rows_reset == 3


@pytest.mark.parametrize("hot", [False, True])
def test_positions(spark, hot):
    random.seed(3)
    given = [("hot" if hot or i % 3 else f"k{i % 7}", random.randint(0, 50), f"{i:05d}") for i in range(3000)]
    given += [(None, 1, "x"), (None, 0, "y")]
    df = spark.createDataFrame(given, "k string, t int, id string").repartition(8)
    got = {(k, i): p for k, _, i, p in rows(ranking.positions(df, ["k"], ["t", "id"]))}
    groups = defaultdict(list)
    for k, t, i in given:
        groups[k].append((t, i))
    want = {(k, i): p for k, g in groups.items() for p, (_, i) in enumerate(sorted(g), 1)}
    assert got == want


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_flush_assignment_equals_a_simulated_schedule(spark, cap):
    random.seed(cap)
    given = []
    for i in range(300):
        priority = random.choice(["High", "Medium", "Not Necessary", "Critical"])
        burst = random.choice([0, 0, 3, 40]) * HOUR_MS
        given.append((f"e{i}", priority, NOW + burst + random.randint(0, 5 * HOUR_MS)))
    got = queue.assign_flush(pending(spark, *given), cap)
    got = {r.id: (r.sent_tick, r.flush_at) for r in got.collect()}
    want = {}
    for priority, (period, phase) in queue.FLUSH_SCHEDULE.items():
        waiting = sorted((t, i) for i, p, t in given if p == priority)
        tick = min(((t - phase) // period for t, _ in waiting), default=0)
        while waiting:
            end = (tick + 1) * period + phase
            ready = [w for w in waiting if w[0] < end][:cap]
            want |= {i: (tick, end) for _, i in ready}
            waiting = [w for w in waiting if w not in ready]
            tick += 1
    assert got == want


def test_each_mailbox_has_its_own_flushes(spark):
    given = [(f"e{i}", "High", NOW + i % 3) for i in range(30)]
    box = F.concat(F.lit("box"), F.col("id").substr(2, 9).cast("int") % 2)
    both = queue.assign_flush(pending(spark, *given).withColumn("box", box), 4, ("box", "priority"))
    for i in range(2):
        alone = queue.assign_flush(pending(spark, *given[i::2]), 4)
        want = rows(alone.select("id", "sent_tick"), "id")
        assert rows(both.where(F.col("box") == f"box{i}").select("id", "sent_tick"), "id") == want


def test_not_necessary_is_flushed_at_five_pm(spark):
    midnight = NOW
    table = pending(
        spark,
        ("before", "Not Necessary", midnight + 17 * HOUR_MS - 1),
        ("after", "Not Necessary", midnight + 17 * HOUR_MS),
    )
    got = {r.flush_at for r in queue.flush_windows(table).collect()}
    assert got == {midnight + 17 * HOUR_MS, midnight + 41 * HOUR_MS}


def test_immediate_notification(spark):
    mail = classified(spark, ("m", "Critical", 1)).withColumn("from_addr", F.lit("Harbour Office <desk@harbour.example>"))
    row = routing.immediate_notifications(mail).first()
    assert (row.priority, row.tags, row.markdown, row.message) == (5, ["rotating_light"], True, "sum")
    assert row.title == "🔴 Harbour Office: Subj"


def test_digest_of_21_senders(spark):
    table = pending(spark, *[(f"e{i:02d}", "High", i, None, f"s{i}@x.io") for i in range(21)])
    got = digest.digests(queue.oldest_unsent(table)).orderBy("chunk").collect()
    assert [r.title for r in got] == ["[20 emails] s0, s1, s2, s3 +16 more", "[1 email] s20"]
    assert {r.priority_number for r in got} == {4} and got[0].tags == ["warning"]
    assert got[1].message == f"- **s20**: s e20 [link →]({MESSAGE_LINK}e20)"


def test_digest_groups_one_sender(spark):
    shop = "Tea Store <till@teas.example>"
    table = pending(
        spark,
        ("m1", "High", 1, None, shop, "shipped"),
        ("m2", "High", 2, None, "Hotel <h@x.io>", "folio"),
        ("m3", "High", 3, None, shop, "delivered"),
    )
    row = digest.digests(queue.oldest_unsent(table)).first()
    link = "https://mail.google.com/mail/u/0/#inbox/"
    assert row.title == "[3 emails] Tea Store, Hotel"
    assert row.message == (
        "- **Tea Store** (2):\n  - shipped\n  - delivered\n"
        f"  [link →]({link}m1) [link →]({link}m3)\n\n- **Hotel**: folio [link →]({link}m2)"
    )


def test_digests_cover_each_row_once(spark):
    random.seed(1)
    given = [(f"e{i}", random.choice(["High", "Low"]), random.randint(0, 99), None, f"s{i % 9}@x.io") for i in range(400)]
    flush = queue.oldest_unsent(pending(spark, *given))
    groups = digest.sender_groups(flush, ("priority",)).select(F.explode("rows.id").alias("id"))
    assert sorted(rows(groups)) == sorted(rows(flush.select("id")))
    assert digest.digests(queue.oldest_unsent(pending(spark, ("x", "High", 1, 1)))).count() == 0


def test_delivery(spark):
    attempts = spark.createDataFrame(
        [("a", 0, False), ("a", 3, True), ("b", 4, True), ("b", 0, False), ("c", 0, None)],
        "payload_id string, attempt_no int, ok boolean",
    )
    assert rows(digest.delivery_outcome(attempts), "payload_id") == [("a", True), ("b", False), ("c", False)]
    notes = spark.createDataFrame([(p,) for p in (5, 4, 3, 2, 1, 9)], "priority int")
    assert [r.server_priority for r in digest.deliveries(notes).collect()] == [10, 8, 5, 2, 1, 5]
    body = spark.range(1).select(digest.server_payload(F.lit("t"), F.lit("m"), F.lit(4))).first()[0]
    assert body.startswith('{"title":"t","message":"m","priority":8,"extras":{"client::display":{"contentType":"text/markdown"}')


def test_queues_of_several_mailboxes(spark):
    table = pending(spark, *[(f"e{i:02d}", "High", i) for i in range(50)])
    table = table.withColumn("account", F.when(F.col("received_at") % 2 == 0, "a").otherwise("b"))
    by = ("account", "priority")
    got = digest.digests(queue.oldest_unsent(table, limit=22, by=by), by)
    assert rows(got.select("account", "chunk", "n"), "account", "chunk") == [
        ("a", 0, 20), ("a", 1, 2), ("b", 0, 20), ("b", 1, 2),
    ]


def test_failed_chunk_stays_queued(spark):
    table = pending(spark, *[(f"e{i:02d}", "High", i) for i in range(25)])
    flush = queue.oldest_unsent(table)
    outcome = spark.createDataFrame([("High", 0, True), ("High", 1, False)], "priority string, chunk int, delivered boolean")
    marked = queue.mark_sent(table, digest.delivered_ids(flush, outcome), NOW)
    assert rows(queue.unsent(marked).select("id"), "id") == [(f"e{i}",) for i in range(20, 25)]


def test_actions_log_and_alerts(spark):
    mail = classified(spark, ("a", "Critical", 1), ("b", "Low", 1), ("c", "Ignore", 1))
    assert rows(routing.mailbox_actions(mail), "id") == [("a", ["AI/Work"], []), ("b", ["AI/Work"], ["UNREAD"])]
    assert rows(routing.add_route(mail).select("id", "route"), "id") == [
        ("a", "immediate"), ("b", "queue"), ("c", "discard"),
    ]
    done = mail.select(
        "id", "verdict", F.lit(NOW + 5).alias("finished_at"), F.lit(12).alias("duration_ms"),
        F.when(F.col("id") == "b", F.lit("x" * 300)).alias("error"),
    )
    lines = [r.line for r in routing.processing_log(done).orderBy("id").collect()]
    assert lines[0] == (
        '{"ts":"2024-01-31T00:00:00.005Z","level":"info","event":"email.processed","messageId":"a",'
        '"priority":"Critical","label":"Work","method":"openrouter","durationMs":12}'
    )
    assert '"level":"error"' in lines[1] and "priority" not in lines[1]
    assert not any("subject" in line or "body" in line or "Subj" in line for line in lines)
    alert = routing.failure_alerts(done).collect()
    assert [(a.id, a.message, a.markdown) for a in alert] == [("b", "[SYSTEM] " + "x" * 280, False)]


def test_labels(spark):
    mail = spark.createDataFrame([("1", "a", "Work"), ("2", "a", "Bills"), ("3", "b", "Work")], "id string, account string, label string")
    known = spark.createDataFrame([("a", "AI/Work", "L1")], "account string, name string, label_id string")
    every = labels.get_or_create_labels(mail, known)
    got = dict(rows(labels.with_label_id(mail, every).select("id", "label_id")))
    assert got["1"] == "L1" and len(set(got.values())) == 3 and every.count() == 3
    again = labels.get_or_create_labels(mail, every)
    assert rows(again, "account", "name") == rows(every, "account", "name")


def test_state(spark):
    empty = spark.createDataFrame([], STATE)
    key = spark.createDataFrame([("k",), ("missing",)], "key string")

    def change(*given):
        return spark.createDataFrame(list(given), STATE)

    one = state.upsert(empty, change(("k", "v1", 1)))
    two = state.upsert(one, change(("k", "v2", 1), ("j", "w", 5), ("j", "x", 4)))
    assert rows(state.lookup(key, one), "key") == [("k", "v1"), ("missing", None)]
    assert rows(two, "key") == [("j", "w", 5), ("k", "v2", 1)]
    kept = state.insert_absent(two, change(("k", "no", 9), ("new", "b", 2), ("new", "a", 1)))
    assert rows(kept, "key") == [("j", "w", 5), ("k", "v2", 1), ("new", "a", 1)]
    cursor = state.cursor_changes(spark.createDataFrame([("a@b.c", "7")], "account string, cursor string"), 3)
    assert rows(state.cursors(two.union(cursor))) == [("a@b.c", "7")]


def test_statistics(spark):
    seen = spark.createDataFrame(
        [("a", NOW - DAY_MS), ("b", NOW - DAY_MS + 1), ("c", 1704067200000), ("d", 1704067200001)],
        "message_id string, processed_at bigint",
    )
    assert tuple(stats.processed_counts(seen, NOW).first()) == (1, 3)
    table = pending(spark, ("a", "High", 1), ("b", "High", 1, 2), ("c", "Odd", 1))
    assert rows(stats.pending_counts(table), "priority") == [
        ("High", 1), ("Low", 0), ("Medium", 0), ("Not Necessary", 0), ("Odd", 1),
    ]


def test_tables_round_trip(spark, tmp_path):
    table = pending(spark, ("a", "High", 1), ("b", "Low", 2, 3))
    table.write.parquet(str(tmp_path / "pending"))
    assert rows(read_table(spark, str(tmp_path / "pending"), "pending_emails"), "id") == rows(table, "id")
