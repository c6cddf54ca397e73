from __future__ import annotations

import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from postsift.sources import attachments, messages


def b64(text, encoding="utf-8"):
    data = text if isinstance(text, bytes) else text.encode(encoding)
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def part(mime, text=None, parts=None, filename=None, size=None, attachment=None, cid=None, raw=None):
    body = {"size": len(text or "") if size is None else size}
    if text is not None:
        body["data"] = b64(text)
    if raw is not None:
        body["data"] = raw
    if attachment:
        body["attachmentId"] = attachment
    out = {"mimeType": mime, "body": body}
    if parts is not None:
        out["parts"] = parts
    if filename is not None:
        out["filename"] = filename
    if cid is not None:
        out["headers"] = [{"name": "content-ID", "value": cid}]
    return out


def message(payload, mid="m1", headers=(), **more):
    payload = {**payload, "headers": [{"name": n, "value": v} for n, v in headers]}
    return json.dumps({"id": mid, "threadId": "t", "snippet": "snip", "payload": payload, **more})


def parse(spark, *raw, **options):
    df = spark.createDataFrame([(m,) for m in raw], "message string")
    return messages.parse_messages(df, **options)


def body(spark, payload, **options):
    row = parse(spark, message(payload), **options).first()
    return row.body_text if row.reject_reason is None else row.reject_reason


def test_fields(spark):
    headers = [("From", "a"), ("SUBJECT", "s1"), ("Subject", "s2"), ("X", "1")]
    row = parse(spark, message(part("text/plain", "hi"), headers=headers, labelIds=["INBOX"])).first()
    assert (row.id, row.thread_id, row.from_addr, row.subject, row.date, row.snippet) == (
        "m1", "t", "a", "s2", "", "snip",
    )
    assert row.labels == ["INBOX"] and row.headers == {"from": "a", "subject": "s2", "x": "1"}
    assert parse(spark, message(part("text/plain", "hi"))).first().labels == []


def test_bad_messages_keep_their_row(spark):
    good = message(part("text/plain", "hi"))
    got = parse(spark, "{broken", good, '{"id":"x"}', message(part("text/plain", raw="!!!"), "m2"))
    assert [r.reject_reason for r in got.collect()] == ["bad_message", None, "bad_message", "bad_body"]


def test_first_text_in_document_order(spark):
    html, plain = part("text/html", "<b>h</b>"), part("text/plain", "p")
    mixed = "multipart/mixed"
    assert body(spark, part(mixed, parts=[html, plain])) == "h"
    assert body(spark, part(mixed, parts=[plain, html])) == "p"
    assert body(spark, part(mixed, parts=[part("text/html", "<br>"), plain])) == "p"
    assert body(spark, part(mixed, parts=[part(mixed, parts=[]), part(mixed, parts=[plain]), html])) == "p"
    assert body(spark, part(mixed, parts=[part("Text/Plain", "no"), plain])) == "p"
    assert body(spark, part(mixed, parts=[part("text/plain", "named", filename="x.txt"), plain])) == "named"
    assert body(spark, part(mixed, parts=[part("text/html", "<i>", parts=[plain]), part("text/plain", "z")])) == "z"
    assert body(spark, part(mixed, parts=[part("application/pdf", "x")])) == ""
    assert body(spark, part(mixed, parts=[plain, part("text/plain", raw="!!!")])) == "p"
    assert body(spark, part(mixed, parts=[part("text/plain", raw="!!!"), plain])) == "bad_body"


def test_body_is_redacted_then_cut(spark):
    text = "x" * 2040 + " 123-45-6789 tail"
    assert body(spark, part("text/plain", text)) == "x" * 2040 + " [REDACT"
    assert body(spark, part("text/plain", "é")) == "Ã©"
    assert body(spark, part("text/plain", "é"), charset="UTF-8") == "é"


def deep(levels):
    inner = part("text/plain", "bottom")
    for _ in range(levels):
        inner = part("multipart/mixed", parts=[part("image/png", "i"), inner])
    return inner


def test_trees_of_any_depth(spark):
    for levels in (1, 5, 6, 7, 40):
        row = parse(spark, message(deep(levels))).first()
        assert row.body_text == "bottom" and row.reject_reason is None
        assert len(row.nodes) == 2 * levels + 1
        assert [n.path for n in row.nodes] == sorted(n.path for n in row.nodes)
    walked = parse(spark, message(deep(9))).first()
    assert parse(spark, message(deep(9)), depth=9).first().nodes == walked.nodes
    assert parse(spark, message(deep(7)), deep_trees=False).first().reject_reason == "too_deep"


def odd(levels):
    """A tree whose fields, some levels down, are of other types than they should be."""
    inner = [
        None,
        {"mimeType": "image/png", "filename": 12, "body": {"size": "9", "data": b64("i")}, "headers": 7},
        {"mimeType": True, "filename": {"a": [1.50, None]}, "body": "x", "parts": "y"},
        {"body": {"size": 3.5, "attachmentId": 1e3}, "headers": [None, {"name": "Content-ID", "value": 5}]},
        {"parts": [5]},
        {"mimeType": "text/plain", "body": {"size": 6, "data": b64("bottom")}},
    ]
    tree = part("multipart/mixed", parts=inner)
    for _ in range(levels - 1):
        tree = part("multipart/mixed", parts=[tree])
    return message(tree)


def test_odd_deep_trees_are_read_like_shallow_ones(spark):
    typed = parse(spark, odd(9), depth=10).first()
    walked = parse(spark, odd(9)).first()
    assert walked.nodes == typed.nodes
    assert (walked.body_text, walked.reject_reason) == ("bottom", None)
    shallow = parse(spark, odd(2)).first()
    assert [n[1:] for n in shallow.nodes[-6:]] == [n[1:] for n in walked.nodes[-6:]]


def test_an_unreadable_tree_costs_its_own_row(spark):
    texts = ['{"id": "m", "payload": ' + '{"parts": [' * 100_000, '{"id": "m"}', "[]", None]
    df = spark.createDataFrame([(t,) for t in [*texts, message(deep(8))]], "message string")
    got = messages.parse_messages(df).select("reject_reason", "body_text").collect()
    assert [r.reject_reason for r in got] == ["bad_message"] * 4 + [None] and got[-1].body_text == "bottom"


def test_braces_and_wide_levels_in_deep_trees(spark):
    """Twelve children on each of three levels below the typed ones: document order is by number."""
    leaf = part("text/plain", "{{{ }", filename="{")
    tree = part("multipart/mixed", parts=[leaf] * 12)
    for _ in range(8):
        tree = part("multipart/mixed", parts=[part("image/png", "i")] * 11 + [tree])
    typed, folded = (parse(spark, message(tree), depth=d).first() for d in (10, 6))
    assert folded.nodes == typed.nodes and len(folded.nodes) == 8 * 12 + 13
    assert [list(n.path) for n in folded.nodes] == sorted(list(n.path) for n in folded.nodes)
    assert folded.body_text == "{{{ }"


def test_headers_last_wins(spark):
    named = [("a", "1"), ("B", "2"), ("A", "3"), (None, "4"), ("b", None), ("c", "")]
    df = spark.createDataFrame([(named,), ([],), (None,)], "h array<struct<name:string,value:string>>")
    got = df.select(messages.header_map(messages.named_headers(F.col("h"))).alias("m")).collect()
    assert [r.m for r in got] == [{"a": "3", "b": None, "c": ""}, {}, {}]


def test_no_python_for_messages(spark):
    df = spark.createDataFrame([(message(deep(2)),)], "message string")
    plan = messages.mime_parts(messages.parse_messages(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mime_rows(spark):
    payload = part("multipart/mixed", parts=[part("Text/HTML; x", "<p>", cid=""), part("image/png", "i", cid="c")])
    got = messages.mime_parts(parse(spark, message(payload)))
    want = [([], "multipart/mixed", True, None), ([0], "text/html", False, None), ([1], "image/png", False, "c")]
    assert rows(got.select("path", "mime_type", "is_container", "content_id"), "path") == want


def attach(spark, payload, store=()):
    table = spark.createDataFrame(list(store), "message_id string, attachment_id string, data string")
    return attachments.with_attachments(parse(spark, message(payload)), table).first()


def mixed(*parts):
    return part("multipart/mixed", parts=list(parts))


def test_images(spark):
    store = [("m1", f"s{i}", b64(f"stored {i}")) for i in (1, 2)] + [("m1", "bad", "!"), ("m2", "s9", b64("x"))]
    row = attach(
        spark,
        mixed(
            part("image/png", "0", cid="a"),
            part("image/gif", "again", cid="a"),
            part("image/png", "", cid=""),
            part("image/png", "big", size=1048577, cid="b"),
            part("image/png", "after big", cid="b"),
            part("image/PNG;x=y", attachment="s1"),
            part("image/png", attachment="bad"),
            part("image/png", attachment="s9"),
            part("image/jpeg", attachment="s2", size=1048576),
            part("image/png", "3"),
            mixed(part("image/png", "4")),
            part("image/png", "5"),
            part("image/png", raw="!!!"),
        ),
        store,
    )
    texts = [base64.b64decode(u.split(",")[1]).decode() for u in row.images]
    assert texts == ["0", "stored 1", "stored 2", "3", "4"]
    assert row.images[1].startswith("data:image/png;base64,") and row.reject_reason is None


def test_broken_inline_data_rejects_the_message_only_when_reached(spark):
    broken = part("image/png", raw="!!!")
    assert attach(spark, mixed(part("image/png", "0"), broken)).reject_reason == "bad_attachment"
    assert attach(spark, mixed(*[part("image/png", str(i)) for i in range(5)], broken)).reject_reason is None
    full = part("text/plain", "f" * 2000, filename="f")
    broken_text = part("text/plain", raw="!!!", filename="g")
    assert attach(spark, mixed(full, broken_text)).reject_reason is None
    first = part("text/plain", "body")
    assert attach(spark, mixed(first, broken_text, full)).reject_reason == "bad_attachment"


def test_text_budget(spark):
    def text(value):
        return part("text/plain", value, filename="n.txt")

    assert attach(spark, mixed(text(" a "), text(" "), text("b"), part("text/plain", "unnamed"))).attachment_text == "a\nb"
    row = attach(spark, mixed(text("a" * 1990), text("b" * 50), text("c")))
    assert row.attachment_text == "a" * 1990 + "\n" + "b" * 10
    secret = "x" * 1990 + " 123-45-6789"
    assert attach(spark, mixed(text(secret))).attachment_text == "x" * 1990 + " [REDACTED"
    # PDF text is cut first: the cut secret is no secret any more.
    pdf = part("application/pdf", attachment="p")
    store = [("m1", "p", b64(f"BT ({secret}) ET"))]
    assert attach(spark, mixed(pdf), store).attachment_text == "x" * 1990 + " 123-45-67"
    assert attach(spark, mixed(pdf, text("t")), store).attachment_text == "x" * 1990 + " 123-45-67"
    assert attach(spark, mixed(pdf, text("t"))).attachment_text == "t"
    assert attach(spark, mixed(text("é﻿"))).attachment_text == "é"


def test_pdf_blocks_stop_at_the_budget(spark):
    first = "a" + " " * 2100 + "b"
    store = [("m1", "p", b64(f"BT ({first}) ET BT (never read) ET"))]
    row = attach(spark, mixed(part("application/pdf", attachment="p")), store)
    assert row.attachment_text == "a b"
    store = [("m1", "p", b64("BT (one) (two) ET BT <7468726565> ET"))]
    row = attach(spark, mixed(part("application/pdf", attachment="p")), store)
    assert row.attachment_text == "one two three"


def test_many_lookups_are_fetched_as_few_are(spark, tmp_path, monkeypatch):
    one = [part("image/png", attachment="s"), part("application/pdf", attachment="s"), part("text/plain", attachment="t", filename="t")]
    mails = [message(mixed(*one)).replace('"m1"', f'"m{i}"') for i in range(6)]
    raw = spark.createDataFrame([(m,) for m in mails], "message string")
    kept = [(f"m{i}", name, b64(f"BT ({name} {i}) ET")) for i in range(5) for name in "stu"]
    spark.createDataFrame(kept, attachments.STORE).write.parquet(f"{tmp_path}/store")
    store = spark.read.parquet(f"{tmp_path}/store")

    def run():
        return attachments.with_attachments(messages.parse_messages(raw), store).select("id", "attachment_text", "images")

    few = rows(run(), "id")
    assert few[0][1] == "s 0\nBT (t 0) ET" and len(few[0][2]) == 1 and few[5][1:] == ("", [])
    monkeypatch.setattr(attachments, "MOST_BROADCAST", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = run()
        assert rows(many, "id") == few
        many.collect()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        text = many._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    final = text[: text.index("== Initial Plan ==")]
    ids = set(re.findall(r"(?<!Reused)Exchange \((\d+)\)", final))
    moved = [i for i, given in re.findall(r"\((\d+)\) Exchange\nInput \[\d+\]: \[(.*)\]", text) if i in ids and "data#" in given]
    assert len(moved) == 1


def test_fetch_bytes(spark):
    parts = spark.createDataFrame(
        [("m", "a", 5, None), ("m", "b", 1048577, None), ("m", None, 1, b64("in")), ("m", "zz", 1, None), ("n", "a", None, None)],
        "message_id string, attachment_id string, size bigint, data string",
    )
    store = spark.createDataFrame(
        [("m", "a", b64("A")), ("m", "b", b64("B"))], "message_id string, attachment_id string, data string"
    )
    got = attachments.fetch_bytes(parts, store).select("message_id", "attachment_id", F.col("bytes").cast("string"))
    assert sorted(rows(got), key=str) == sorted(
        [("m", "a", "A"), ("m", "b", None), ("m", None, "in"), ("m", "zz", None), ("n", "a", None)], key=str
    )


def test_pdf_objects_without_python(spark):
    """Odd files, long pieces and random ones against the plain scan of one file."""
    import random

    from postsift.functions import pdf
    from postsift.functions.text import ATTACHMENT_CHARS

    def plain(data):
        found, total = [], 0
        for pieces in pdf.text_objects(data) if data is not None else []:
            if pieces and total < ATTACHMENT_CHARS:
                text = re.sub(rf"[{pdf.WHITE_SPACE}]+", " ", " ".join(pieces))[: ATTACHMENT_CHARS + 2]
                found.append((sum(map(len, pieces)), text))
                total += found[-1][0]
        return None if data is None else found

    rng = random.Random(5)
    bits = [b"BT", b"ET", b" ", b"(", b")", b"\\", b"<", b">", b"414", b"a", b"xyz", b"\\101", b"\\908", b"\\777", b"\\779", b"\\223", b"\\n", b"\\(",
            b"\n", b"\r", b"_", b"stream\n", b"endstream", b"\x85", b"\x93q\x94", b"\x81", b"\xa0", b"\xe9", b"\0", b"7f207e"]
    files = [None, b"", b"BT", b"BTET", b"xBT (ab)ET", b"BT (ab) _ET ET2 ET", b"BT (a) (ab) (\\\n (cd) ET", b"BT (" + b"\\a" * 200_000 + b") ET",
             b"BT (" + b"(" * 3000 + b" ET", b"BT (x" + b" " * 2100 + b"y) ET BT (never) ET", b"stream\n BT (hid) ET endstream BT <4869> ET"]
    files += [b"BT (" + b"".join(rng.choices(bits, k=rng.randint(1, 40))) + b") ET" for _ in range(400)]
    files += [b" ".join(b"BT" + b"".join(rng.choices(bits, k=9)) + b" ET" for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(files)), "i int, data binary").repartition(8)
    read = df.select("i", pdf.pdf_objects(F.col("data")).alias("objects"))
    got = {r.i: r.objects and [tuple(o) for o in r.objects] for r in read.collect()}
    assert got == {i: plain(data) for i, data in enumerate(files)}
    assert sum(bool(found) for found in got.values()) > 300


def test_no_python_for_attachments(spark, tmp_path):
    """Nor does reading them, few or many, ask the store for what no message looks up."""
    pdf = mixed(part("application/pdf", attachment="p"), part("application/pdf", "BT (in) ET"))
    df = spark.createDataFrame([(message(pdf),)], "message string")
    store = spark.createDataFrame([("m1", "p", b64("BT (out) ET")), ("m1", "q", "!")], attachments.STORE)
    for most in (0, 10):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(attachments, "MOST_BROADCAST", most)
            got = attachments.with_attachments(messages.parse_messages(df), store)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan) and got.first().attachment_text == "out\nin"


@pytest.mark.parametrize("most", [0, 1000])
def test_only_images_beyond_five_are_asked_for_beforehand(spark, monkeypatch, most):
    """The first five usable ones count, whichever of the store's can be read."""
    monkeypatch.setattr(attachments, "MOST_BROADCAST", most)
    names = [f"s{i}" for i in range(8)]
    tree = mixed(*[part("image/png", attachment=s) for s in names], part("text/plain", attachment="t", filename="t"))
    few = mixed(*[part("image/png", attachment=s) for s in names[:3]])
    df = spark.createDataFrame([(message(tree),), (message(few).replace('"m1"', '"m2"'),)], "message string")
    store = [(m, s, "!" if s in ("s1", "s2") else b64(f"{m}{s}")) for m in ("m1", "m2") for s in [*names[:7], "t"]]
    stored = spark.createDataFrame(store, attachments.STORE)
    wanted = messages.parse_messages(df).select(
        F.col("id").alias("message_id"), attachments._wanted(attachments.attachment_parts(attachments.attachment_leaves(F.col("nodes")))).alias("wanted")
    )
    chosen = {r.message_id: [c.lookup for c in r.chosen] for r in attachments._chosen(wanted, stored).collect()}
    assert chosen == {"m1": ["s0", "s3", "s4", "s5", "s6", "t"], "m2": names[:3]}
    got = attachments.with_attachments(messages.parse_messages(df), stored).orderBy("id").collect()
    texts = [[base64.b64decode(u.split(",")[1]).decode() for u in r.images] for r in got]
    assert texts == [["m1s0", "m1s3", "m1s4", "m1s5", "m1s6"], ["m2s0"]] and got[0].attachment_text == "m1t"
