from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from postsift.operators import digest, queue, scoring
from postsift.sources.attachments import STORE
from postsift.sources.tables import PENDING, STATE
from postsift.streaming import dedupe, delivery, digests, limits, ordered, tables, triage, windows
from test_limits import history, outcomes, simulate

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


class Feed:
    """Feeds a stream one file at a time, with one run per file."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.root, self.schema = spark, tmp_path, schema

    def source(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.root}/in")

    def run(self, batches, writer):
        for batch in batches:
            df = self.spark.createDataFrame(batch, self.schema).coalesce(1)
            df.write.mode("append").parquet(f"{self.root}/in")
            start = writer().option("checkpointLocation", f"{self.root}/checkpoint")
            start.trigger(availableNow=True).start().awaitTermination()


def collect_to(path):
    return lambda batch, batch_id: tables.write_batch(batch, path, batch_id)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.mark.parametrize("spread", [1, 3])
def test_dedupe(spark, tmp_path, spread):
    feed = Feed(spark, tmp_path, "account string, history_id string, ts timestamp")
    batches = [
        [("a", "1", at(0)), ("a", "1", at(1)), ("b", "1", at(0))],
        [("a", "1", at(30)), ("a", "2", at(30)), ("c", "9", at(100))],
        [("a", "3", at(-900)), ("a", "1", at(101)), ("a", "1", at(102))],
        [("d", "1", at(103))],
    ]
    out = f"{tmp_path}/out"
    feed.run(batches, lambda: dedupe.new_notifications(feed.source(), spread=spread).writeStream.foreachBatch(collect_to(out)))
    got = sorted((r.account, r.history_id) for r in tables.read_all(spark, out).collect())
    # Memory is by processing time: ("a", "3"), however old, is new, and ("a", "1") still known.
    assert got == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("c", "9"), ("d", "1")]


def test_dedupe_forgets(spark, tmp_path):
    feed = Feed(spark, tmp_path, "account string, history_id string")
    out = f"{tmp_path}/out"

    def writer():
        fresh = dedupe.new_notifications(feed.source(), memory="1 second")
        return fresh.writeStream.foreachBatch(collect_to(out))

    for row in [("a", "1"), ("b", "1"), ("c", "1"), ("a", "1")]:
        feed.run([[row]], writer)
        time.sleep(2.5)
    assert tables.read_all(spark, out).where("account = 'a'").count() == 2


def test_dedupe_without_the_account(spark, tmp_path):
    feed = Feed(spark, tmp_path, "account string, history_id string, ts timestamp")
    out = f"{tmp_path}/out"
    feed.run(
        [[("a", "1", at(0)), ("b", "1", at(1))]],
        lambda: dedupe.new_notifications(feed.source(), by_account=False).writeStream.foreachBatch(collect_to(out)),
    )
    assert tables.read_all(spark, out).count() == 1


def test_flush_windows_equal_the_batch_twin(spark, tmp_path):
    feed = Feed(spark, tmp_path, "priority string, received_at bigint")
    names = ["High", "Medium", "Low", "Not Necessary", "Critical"]
    every = [(names[i % 5], int(at(i / 7).timestamp() * 1000)) for i in range(900)]
    out = f"{tmp_path}/out"
    sink = windows.count_flushes(out)
    batches = [every[:300], every[300:600], every[600:]]
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))
    batch = queue.flush_windows(spark.createDataFrame(every, feed.schema)).withColumn("n_late", F.lit(0))
    want = rows(batch, "priority", "flush_at")
    assert rows(windows.flush_counts(spark, out), "priority", "flush_at") == want
    sink(spark.createDataFrame(every[300:600], feed.schema), 1)  # a retry
    assert rows(windows.flush_counts(spark, out), "priority", "flush_at") == want


def test_late_queue_rows_go_with_the_next_flush(spark, tmp_path):
    def ms(hours):
        return int(at(hours).timestamp() * 1000)

    feed = Feed(spark, tmp_path, "priority string, received_at bigint")
    out = f"{tmp_path}/out"
    batches = [[("Medium", ms(0)), ("Medium", ms(5.5))], [("Medium", ms(1)), ("Medium", ms(5.2))]]
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(windows.count_flushes(out)))
    got = rows(windows.flush_counts(spark, out), "flush_at")
    assert got == [("Medium", ms(1), 1, 0), ("Medium", ms(6), 3, 1)]


def test_limits_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "service string, id bigint, ts bigint, ok boolean")
    calls = history(11, 600, ("a", "b"), step=(1, 600_000), p_ok=0.4)
    sink = limits.limit_calls(f"{tmp_path}/out", quota=10)
    feed.run([calls[:200], calls[200:400], calls[400:]], lambda: feed.source().writeStream.foreachBatch(sink))
    assert outcomes(tables.read_all(spark, f"{tmp_path}/out/calls")) == simulate(calls, 10)
    # A retried micro-batch replaces its own output.
    sink(spark.createDataFrame(calls[400:], feed.schema), 2)
    assert outcomes(tables.read_all(spark, f"{tmp_path}/out/calls")) == simulate(calls, 10)
    assert tables.read_all(spark, f"{tmp_path}/out/calls").count() == 600


def test_late_calls_meet_the_quota_of_their_day(spark, tmp_path):
    """Days late, a used-up day denies them, and the breaker stays as later calls have left it."""
    feed = Feed(spark, tmp_path, "service string, id bigint, ts bigint, ok boolean")
    day = 86_400_000
    first, later = 19_000 * day, 19_005 * day
    batches = [
        [("a", 1, first, True), ("a", 2, first + 1, True), ("a", 3, first + 2, True)],
        [("a", 4, later, False), ("a", 5, later + 1, False)],
        [("a", 6, first + 3, True), ("a", 7, first + 4, True)],
        [("a", 8, later - 3 * day, True), ("a", 9, first + 5, False)],
        [("a", 10, later + 2, False), ("a", 11, later + 3, False), ("a", 12, later + 4, False), ("a", 13, later + 5, True)],
        [("a", 14, first + 6, True), ("a", 15, later + 6, True), ("a", 16, later + 600_000, True)],
    ]
    sink = limits.limit_calls(f"{tmp_path}/out", quota=2, limit=3)
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))
    got = outcomes(tables.read_all(spark, f"{tmp_path}/out/calls"))
    want = "ok ok quota failed failed quota quota ok quota failed failed failed open open open ok"
    assert [got["a", i] for i in range(1, 17)] == want.split()


def test_late_calls_leave_the_breaker_as_it_is(spark, tmp_path):
    feed = Feed(spark, tmp_path, "service string, id bigint, ts bigint, ok boolean")
    day = 86_400_000
    first, later = 19_000 * day, 19_005 * day
    batches = [
        [("a", 1, first, True), ("a", 2, first + 1, True)],
        [("a", 3, later, False), ("a", 4, later + 1, False)],
        [("a", 5, first + 2, True)],
        [("a", 6, later + 2, False), ("a", 7, later + 3, True)],
    ]
    sink = limits.limit_calls(f"{tmp_path}/out", quota=2, limit=3)
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))
    got = outcomes(tables.read_all(spark, f"{tmp_path}/out/calls"))
    assert [got["a", i] for i in range(1, 8)] == "ok ok failed failed quota failed open".split()


def test_cursor_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "account string, history_id string, ts bigint")
    first = spark.createDataFrame([("gmail:history_id:z", "0", 0)], STATE)
    sink = triage.keep_cursors(f"{tmp_path}/out")
    batches = [[("a", "1", 1), ("a", "2", 2)], [("b", "5", 3)], [("a", "9", 4), ("b", "4", 2)]]
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))
    got = rows(triage.current_state(f"{tmp_path}/out", first), "key")
    assert [(k[-1], v) for k, v, _ in got] == [("a", "9"), ("b", "5"), ("z", "0")]


def mail(mid, subject, labels=(), parts=None):
    payload = {"mimeType": "text/plain", "body": {"size": 0}, "headers": [{"name": "Subject", "value": subject}]}
    if parts is not None:
        payload |= {"mimeType": "multipart/mixed", "parts": parts}
    return json.dumps({"id": mid, "threadId": "t", "snippet": "s", "labelIds": list(labels), "payload": payload})


def test_triage_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "message string, received_at bigint")
    out = f"{tmp_path}/out"
    sink = triage.triage(out, scoring.keyword_scorer({"Critical": ("urgent",)}))
    batches = [
        [(mail("m1", "Urgent!"), 1), ("{broken", 2), (mail("m2", "sale", ["SPAM"]), 3), (mail("m1", "Urgent!"), 9)],
        [(mail("m3", "lunch"), 4), (mail("m1", "Urgent!"), 1), (mail("m3", "lunch"), 4)],
    ]
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))

    def read(name, *columns):
        return rows(tables.read_all(spark, f"{out}/{name}").select(*columns))

    def check():
        assert read("quarantine", "received_at", "reject_reason") == [(2, "bad_message")]
        assert sorted(read("duplicates", "id", "received_at")) == [("m1", 1), ("m1", 9), ("m3", 4)]
        assert sorted(read("settled", "id", "route")) == [("m1", "immediate"), ("m2", "discard"), ("m3", "queue")]
        assert read("queue", "id", "priority") == [("m3", "Low")]
        assert read("immediate", "id", "priority") == [("m1", 5)]
        assert sorted(read("actions", "id", "remove_labels")) == [("m1", []), ("m3", ["UNREAD"])]
        assert read("alerts", "message") == [("[SYSTEM] bad_message",)]
        lines = [json.loads(line) for (line,) in read("log", "line")]
        assert sorted((x["event"], x.get("error")) for x in lines) == [
            ("email.process_error", "bad_message"),
            *[("email.processed", None)] * 3,
        ]
        assert all(x["durationMs"] >= 0 for x in lines if "error" not in x)

    check()
    sink(spark.createDataFrame(batches[1], feed.schema), 1)  # a retry
    check()


def test_triage_stream_keeps_the_quota(spark, tmp_path):
    """One scored mail a day: the next one gets the fallback, in the same micro-batch or later."""
    feed = Feed(spark, tmp_path, "message string, received_at bigint")
    out = f"{tmp_path}/out"
    sink = triage.triage(out, scoring.keyword_scorer({"Critical": ("urgent",)}), quota=1)
    day = 86_400_000
    batches = [
        [(mail("m1", "Urgent!"), 1), (mail("m2", "Urgent!"), 2), (mail("m3", "sale", ["SPAM"]), 3)],
        [(mail("m4", "Urgent!"), 4), (mail("m5", "Urgent!"), day + 1)],
    ]
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))

    def check():
        got = rows(tables.read_all(spark, f"{out}/settled").select("id", "verdict.method"), "id")
        assert got == [("m1", "openrouter"), ("m2", "fallback"), ("m3", "rule"), ("m4", "fallback"), ("m5", "openrouter")]

    check()
    sink(spark.createDataFrame(batches[1], feed.schema), 1)  # a retry
    check()


def test_triage_stream_reads_attachments(spark, tmp_path):
    import base64

    def coded(text):
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    note = {"mimeType": "text/plain", "filename": "a.txt", "body": {"size": 9, "attachmentId": "n"}}
    image = {"mimeType": "image/png", "body": {"size": 3, "data": coded("png")}}
    store = spark.createDataFrame([("m1", "n", coded("please read: urgent"))], STORE)
    sink = triage.triage(f"{tmp_path}/out", scoring.keyword_scorer({"Critical": ("urgent",)}), store=store)
    sink(spark.createDataFrame([(mail("m1", "hello", parts=[note, image]), 1)], "message string, received_at bigint"), 0)
    got = tables.read_all(spark, f"{tmp_path}/out/settled").select("attachment_text", "n_images", "route")
    assert rows(got) == [("please read: urgent", 1, "immediate")]


def test_delivery_stream(spark, tmp_path):
    pending = spark.createDataFrame([(f"e{i:02d}", "a@b.c", "", "", "High", i, None) for i in range(45)], PENDING)
    flush = queue.oldest_unsent(pending)
    feed = Feed(spark, tmp_path, "priority string, chunk int, delivered boolean, ts bigint")
    sink = triage.mark_deliveries(f"{tmp_path}/out", flush)
    batches = [[("High", 0, False, 1), ("High", 1, True, 2)], [("High", 0, True, 3)], [("High", 2, False, 4)]]
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))
    got = triage.current_queue(f"{tmp_path}/out", pending)
    assert rows(got.groupBy("sent_at").count(), "sent_at") == [(None, 5), (2, 20), (3, 20)]


def flushes_by_hand(micro_batches, cap):
    """Sends and marks of ``scheduled_digests``, one flush after the other."""
    waiting, flying, clock, sent, marks = {}, {}, None, [], {}
    for events in micro_batches:
        outcomes = {}
        for e in events:
            if e.get("flush_at") is not None:
                key = (e["mailbox"], e["priority"], e["flush_at"], e["chunk"])
                ok, at = outcomes.get(key, (False, None))
                if e["delivered"]:
                    ok, at = True, e["at"] if at is None else min(at, e["at"])
                outcomes[key] = (ok, at)
        known = {**waiting, **flying}
        for i, (row, key) in list(flying.items()):
            if key in outcomes:
                del flying[i]
                if outcomes[key][0]:
                    marks[i] = outcomes[key][1]
                else:
                    waiting[i] = row
        for e in sorted((e for e in events if e.get("id")), key=lambda e: e["received_at"]):
            if e["id"] not in known and e["id"] not in waiting:
                waiting[e["id"]] = e
        stated = [e["at"] if e.get("at") is not None else e["received_at"] for e in events]
        new_clock = max([t for t in [clock, *stated] if t is not None], default=None)
        ticks = []
        for name, (period, phase) in queue.FLUSH_SCHEDULE.items():
            first = min((e["received_at"] for e in waiting.values()), default=0) if clock is None else clock
            at = (first - phase) // period * period + period + phase
            while new_clock is not None and at <= new_clock:
                ticks.append((at, name, period))
                at += period
        for at, name, _ in sorted(ticks):
            for mailbox in {e["mailbox"] for e in waiting.values()}:
                due = [e for e in waiting.values() if (e["mailbox"], e["priority"]) == (mailbox, name) and e["received_at"] < at]
                for n, e in enumerate(sorted(due, key=lambda e: (e["received_at"], e["id"]))[:cap]):
                    del waiting[e["id"]]
                    flying[e["id"]] = (e, (mailbox, name, at, n // 20))
                    sent.append((mailbox, name, at, n // 20, e["id"]))
        clock = new_clock
    return sorted(sent), marks, sorted(waiting), sorted(flying)


def test_scheduled_digests(spark, tmp_path):
    """Two mailboxes, late mail, failed and repeated outcomes, a run of the stream per micro-batch."""
    import random

    rng = random.Random(6)
    schema = f"mailbox string, {digests.EVENTS}"
    columns = [f.split()[0] for f in schema.split(", ")]
    hour, start, cap = 3_600_000, int(T0.timestamp() * 1000), 25
    feed = Feed(spark, tmp_path, schema)
    out = f"{tmp_path}/out"
    sink = digests.scheduled_digests(out, cap, mailbox=("mailbox",))
    given, n = [], 0
    for step in range(6):
        events = []
        if step < 4:
            for _ in range(70):
                n += 1
                at = start + int(step * 3 * hour + rng.random() * 3 * hour) - (8 * hour if rng.random() < 0.05 else 0)
                priority = rng.choice(["High", "High", "Medium", "Low", "Not Necessary", "Critical"])
                events.append({"id": f"m{n:03d}", "mailbox": rng.choice("aab"), "priority": priority, "from_addr": "x <x@y.z>",
                               "subject": "s", "summary": "t", "received_at": at})
            events.append(dict(events[0]))
        sent, marks, _, flying = flushes_by_hand(given, cap)
        open_chunks = sorted({s[:4] for s in sent if s[4] in set(flying)})
        for mailbox, priority, flush_at, chunk in open_chunks:
            if rng.random() < 0.8:
                told = {"mailbox": mailbox, "priority": priority, "flush_at": flush_at, "chunk": chunk,
                        "delivered": rng.random() < 0.6, "at": start + step * 3 * hour}
                events += [told] * rng.choice([1, 1, 2])
        if step >= 4:
            events.append({"at": start + step * 12 * hour})
        given.append(events)
        feed.run([[tuple(e.get(c) for c in columns) for e in events]], lambda: feed.source().writeStream.foreachBatch(sink))

    def check():
        sent, marks, waiting, flying = flushes_by_hand(given, cap)
        assert {r.id: r.sent_at for r in digests.marks(spark, out).collect()} == marks and len(marks) > 40
        left = digests.queue_table(spark, out, ("mailbox",)).read()
        assert rows(left.where("flush_at IS NULL").select("id"), "id") == [(i,) for i in waiting]
        assert rows(left.where("flush_at IS NOT NULL").select("id"), "id") == [(i,) for i in flying]
        told = digests.digests_sent(spark, out)
        counts: dict[tuple, int] = {}
        for s in sent:
            counts[s[:4]] = counts.get(s[:4], 0) + 1
        got = {(r.mailbox, r.priority, r.flush_at, r.chunk): r.n for r in told.collect()}
        assert got == counts and told.count() == len(counts)
        assert len({s[4] for s in sent}) < len(sent)  # failed chunks went again

    check()
    last = [tuple(e.get(c) for c in columns) for e in given[-1]]
    sink(spark.createDataFrame(last, schema), 5)  # a retry
    check()


def test_cursors_of_many_micro_batches_stay_in_few_files(spark, tmp_path):
    sink = triage.keep_cursors(f"{tmp_path}/out")
    schema = "account string, history_id string, ts bigint"
    for i in range(25):
        sink(spark.createDataFrame([(f"a{i % 9}", str(i), i)], schema), i)
    got = triage.current_state(f"{tmp_path}/out", spark.createDataFrame([], STATE))
    assert {int(r.value) for r in got.collect()} == set(range(16, 25))
    table = triage._cursors(spark, f"{tmp_path}/out")
    assert len(table.read().inputFiles()) <= 9 and len(table.numbers()) <= table.keep + 1


def test_triage_asks_few_files_of_settled_ids(spark, tmp_path):
    out = f"{tmp_path}/out"
    sink = triage.triage(out, scoring.keyword_scorer({}), seen_buckets=4)
    schema = "message string, received_at bigint"
    for i in range(3):
        sink(spark.createDataFrame([(mail(f"m{i}-{j}", "lunch"), j) for j in range(20)], schema), i)
    seen = triage.SeenIds(spark, f"{out}/seen", 4)
    assert seen.table.read().count() == 60 and len(seen.table.current().files) > 6
    fresh = spark.createDataFrame([(f"n{j}",) for j in range(20)], "id string")
    assert seen.files_for(fresh) == []


def test_limits_in_order_of_time(spark, tmp_path):
    """Arrivals shuffled within the delay end as in the batch fold; what comes later is in ``late``."""
    import random

    rng = random.Random(2)
    calls = history(11, 240, ("a", "b"), step=(1, 600_000), p_ok=0.4)
    first, delay = min(c[2] for c in calls), 5_000_000
    late = [("a", 9000 + i, first - 1 - i, True) for i in range(3)] + [("b", 9100, None, True)]
    arrivals = sorted(calls, key=lambda c: c[2] + rng.random() * 0.9 * delay)
    end = ("z", 9999, max(c[2] for c in calls) + 2 * delay, True)
    batches = [arrivals[:80], [*arrivals[80:160], *late], [*arrivals[160:], end]]
    feed = Feed(spark, tmp_path, "service string, id bigint, ts bigint, ok boolean")
    out = f"{tmp_path}/out"
    sink = ordered.in_order(f"{out}/order", limits.limit_calls(out, quota=10), delay)
    feed.run(batches, lambda: feed.source().writeStream.foreachBatch(sink))

    def check():
        assert outcomes(tables.read_all(spark, f"{out}/calls")) == simulate(calls, 10)
        assert sorted(r.id for r in ordered.late_rows(spark, f"{out}/order").collect()) == [9000, 9001, 9002, 9100]
        assert [r.id for r in ordered.held_rows(spark, f"{out}/order", 2).collect()] == [9999]

    check()
    sink(spark.createDataFrame(batches[2], feed.schema), 2)  # a retry
    check()


def test_rows_are_held_and_let_go(spark, tmp_path):
    given = []
    sink = ordered.in_order(f"{tmp_path}/o", lambda df, i: given.append(sorted(r.ts for r in df.collect())), 10)
    for i, times in enumerate([[], [5, 20, 12], [3, 11, 9], [4, 40, 29], [None]]):
        sink(spark.createDataFrame([(t,) for t in times], "ts bigint"), i)
    assert given == [[], [5], [], [11, 12, 20, 29], []]
    assert sorted(r.ts or 0 for r in ordered.late_rows(spark, f"{tmp_path}/o").collect()) == [0, 3, 4, 9]


def test_deliveries_try_four_times(spark, tmp_path):
    """Bodies say at which try they go through; outcomes equal those of the attempts as a table."""
    folder = tmp_path / "tries"
    folder.mkdir()

    def send(body):
        name, at = body.split()
        with open(folder / name, "a") as f:
            f.write("x")
        if at == "raise":
            raise ValueError(body)
        return len((folder / name).read_text()) >= int(at)

    plan = {"a": "1", "b": "4", "c": "5", "d": "raise", "e": "2"}
    notes = spark.createDataFrame([(k, f"{k} {v}") for k, v in plan.items()], "payload_id string, body string")
    got = delivery.deliver(notes, send, ("payload_id",), waits=(0.0, 0.01, 0.0), now_ms=lambda: 7)
    told = rows(got, "payload_id")
    assert told == [("a", True, 1, 7), ("b", True, 4, 7), ("c", False, 4, 7), ("d", False, 4, 7), ("e", True, 2, 7)]
    attempts = spark.createDataFrame(
        [(k, i, v.isdigit() and i + 1 >= int(v)) for k, v in plan.items() for i in range(6)],
        "payload_id string, attempt_no int, ok boolean",
    )
    assert rows(digest.delivery_outcome(attempts), "payload_id") == [t[:2] for t in told]


def test_digests_are_delivered_and_marked(spark, tmp_path):
    """Mail to digests, digests to deliveries, outcomes back to the queue: two streams and a folder."""
    down = tmp_path / "down"
    down.write_text("1")
    log = tmp_path / "sent"
    log.mkdir()

    def send(body):
        title = json.loads(body)["title"]
        if "b0" in title and down.exists():
            return False
        (log / f"{time.time_ns()}").write_text(title)
        return True

    out, start = f"{tmp_path}/out", int(T0.timestamp() * 1000)
    columns = [f.split()[0] for f in digests.EVENTS.split(", ")]
    feed = Feed(spark, tmp_path, digests.EVENTS)

    def events(*given):
        return [tuple(e.get(c) for c in columns) for e in given]

    def digest_run(batch):
        sink = digests.scheduled_digests(out)
        feed.run([batch], lambda: feed.source().writeStream.foreachBatch(sink))

    sink = delivery.deliver_digests(f"{tmp_path}/outcomes", send, waits=(0.0, 0.0, 0.0))

    def delivery_run():
        schema = digests.digests_sent(spark, out).schema
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/digests")
        run = source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/delivering")
        run.trigger(availableNow=True).start().awaitTermination()
        told = tables.read_all(spark, f"{tmp_path}/outcomes").where(F.col("at") > 0)
        return told.withColumn("at", F.col("flush_at"))

    def mails(name, priority, n):
        return [{"id": f"{name}{i:02d}", "from_addr": f"{name}{i % 2}@x.y", "summary": "t", "subject": "s",
                 "priority": priority, "received_at": start + i} for i in range(n)]

    digest_run(events(*mails("a", "High", 25), *mails("b", "Medium", 3), {"at": start + 2 * 3_600_000}))
    told = delivery_run()
    assert rows(told.select("priority", "chunk", "delivered", "tries"), "priority", "chunk") == [
        ("High", 0, True, 1), ("High", 1, True, 1), ("Medium", 0, False, 4),
    ]
    sink(digests.digests_sent(spark, out), 0)  # the micro-batch again: nothing is sent twice
    assert len(list(log.iterdir())) == 2
    digest_run(events(*[r.asDict() for r in told.collect()]))
    assert digests.marks(spark, out).count() == 25
    assert rows(digests.queue_table(spark, out).read().select("id", "flush_at"), "id") == [(f"b{i:02d}", None) for i in range(3)]
    down.unlink()
    digest_run(events({"at": start + 4 * 3_600_000}))
    told = delivery_run().where("delivered AND priority = 'Medium'")
    digest_run(events(*[r.asDict() for r in told.collect()]))
    assert digests.marks(spark, out).count() == 28 and digests.queue_table(spark, out).read().count() == 0
