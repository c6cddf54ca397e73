from __future__ import annotations

import base64
import json

from conftest import rows
from postsift.functions.clock import DAY_MS
from postsift.operators import accounts, state
from postsift.sources import feed, push

NOW = 1706659200000


def envelope(payload):
    data = base64.b64encode(payload.encode()).decode()
    return json.dumps({"message": {"data": data, "messageId": "p"}})


def test_push_envelopes(spark):
    good = envelope('{"emailAddress":"a@b.co","historyId":12}')
    cases = [
        (good, ("p", "a@b.co", "12", None)),
        ("not json", (None, None, None, "bad_json")),
        (good + "x", (None, None, None, "bad_json")),
        ("5", (None, None, None, "bad_json")),
        ("{}", (None, None, None, "no_message")),
        ('{"message":{"data":"!!","messageId":"p"}}', ("p", None, None, "bad_envelope")),
        ('{"message":{"messageId":"p"}}', ("p", None, None, "bad_envelope")),
        (envelope("null"), ("p", None, None, "bad_envelope")),
        (envelope('{"emailAddress":"nobody","historyId":1}'), ("p", "nobody", "1", "bad_account")),
        (envelope('{"historyId":1}'), ("p", None, "1", "bad_account")),
        (envelope('{"emailAddress":"a@b.co"}'), ("p", "a@b.co", None, "no_history_id")),
    ]
    df = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(cases)], "i int, body string")
    decoded = push.decode_envelopes(df)
    got = rows(decoded.select("i", "push_id", "account", "history_id", "reject_reason"), "i")
    assert [g[1:] for g in got] == [want for _, want in cases]
    assert push.accepted(decoded).count() == 1 and push.quarantined(decoded).count() == 10


def page(history_id, *entries):
    history = [
        {"id": str(i), "messagesAdded": [{"message": {"id": m}} for m in ids]} if ids is not None else {"id": str(i)}
        for i, ids in entries
    ]
    return json.dumps({"historyId": str(history_id), "history": history})


def test_feed(spark):
    pages = feed.parse_pages(
        spark.createDataFrame(
            [
                ("a", 0, page(11, (9, ["m0"]), (10, ["m1", "m2"]))),
                ("a", 1, page(105, (100, ["m3"]), (101, None))),
                ("b", 0, page(7, (6, ["n1"]))),
                ("quiet", 0, '{"historyId":"50"}'),
            ],
            "account string, page_no int, page string",
        )
    )
    who = spark.createDataFrame([(x,) for x in ("a", "b", "new", "quiet", "gap", "expired", "idle")], "account string")
    cursors = spark.createDataFrame(
        [("a", "9"), ("b", "5"), ("quiet", "40"), ("gap", "1"), ("expired", "3"), ("idle", "77")],
        "account string, cursor string",
    )
    status = spark.createDataFrame([("gap", 404), ("expired", 401), ("new", 401)], "account string, status int")
    plan = feed.plan_sync(who, cursors, status)
    assert dict(rows(plan.select("account", "mode"))) == {
        "a": "feed", "b": "feed", "quiet": "feed", "expired": "feed", "idle": "feed", "new": "fallback", "gap": "fallback",
    }
    # Ids are numbers: 10 and 100 come after 9.
    assert sorted(rows(feed.scan_feed(pages, plan))) == [("a", "m1"), ("a", "m2"), ("a", "m3"), ("b", "n1")]
    assert dict(rows(feed.next_cursors(pages, plan))) == {
        "a": "105", "b": "7", "quiet": "50", "expired": "3", "idle": "77",
    }
    notified = spark.createDataFrame([("new", "5", 1), ("new", "4", 2), ("a", "1", 1)], "account string, history_id string, ts int")
    told = dict(rows(feed.next_cursors(pages, plan, notified)))
    assert told["new"] == "4" and told["a"] == "105" and "gap" not in told
    mailbox = spark.createDataFrame(
        [("new", f"x{i:02d}", NOW - i) for i in range(15)] + [("gap", "old", NOW - DAY_MS), ("gap", "fresh", NOW - DAY_MS + 1), ("a", "no", NOW)],
        "account string, message_id string, received_at bigint",
    )
    fallback = feed.scan_fallback(mailbox, plan, NOW)
    assert sorted(rows(fallback)) == [("gap", "fresh")] + [("new", f"x{i:02d}") for i in range(10)]
    seen = spark.createDataFrame([("m2", 1), ("x00", 1)], "message_id string, processed_at bigint")
    new = feed.incoming_ids(pages, mailbox, plan, seen, NOW).select("account", "message_id")
    assert len(rows(new)) == 4 + 11 - 2
    assert feed.unseen(new.union(new), seen).count() == 13


def test_accounts(spark):
    known = spark.createDataFrame([("__primary__", 0), ("a@b.co", 1)], "email string, added_at bigint")
    asked = spark.createDataFrame(
        [(" A@B.co", 5), ("New@x.io ", 6), ("new@x.io", 4), ("bad", 7)], "email string, added_at bigint"
    )
    assert rows(accounts.add_accounts(known, asked), "added_at") == [("a@b.co", 1), ("new@x.io", 4)]
    assert rows(accounts.rejected(asked).select("email")) == [("bad",)]
    assert rows(accounts.remove_accounts(known, asked)) == []
    expiry = spark.createDataFrame([("a@b.co", 9)], "email string, watch_expiry bigint")
    hook = spark.createDataFrame([], "email string, last_webhook bigint")
    assert rows(accounts.list_accounts(known, expiry, hook)) == [("a@b.co", 9, None)]


def test_feed_entries_without_a_number_are_kept(spark):
    page = '{"history":[%s]}' % ",".join(
        '{%s"messagesAdded":[{"message":{"id":"%s"}}]}' % (i, m)
        for i, m in (("", "a"), ('"id":"h7",', "b"), ('"id":"8",', "c"), ('"id":"5",', "d"))
    )
    pages = feed.parse_pages(spark.createDataFrame([("x", 1, page)], "account string, page_no int, page string"))
    plan = spark.createDataFrame([("x", "feed", "5")], "account string, mode string, start_id string")
    assert sorted(r.message_id for r in feed.scan_feed(pages, plan).collect()) == ["a", "b", "c"]


def test_equal_times_never_move_a_cursor_back(spark):
    schema = "key string, value string, updated_at long"
    changes = spark.createDataFrame([("k", "9", 1), ("k", "10", 1)], schema)
    assert state.upsert(spark.createDataFrame([], schema), changes).first().value == "10"
