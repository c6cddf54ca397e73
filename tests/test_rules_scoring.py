from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from postsift.operators import rules, scoring
from postsift.sources.tables import RuleConfig, read_rules
from postsift.streaming import limits

MAIL = "id string, from_addr string, subject string, labels array<string>, headers map<string,string>"
UNSUBSCRIBE = {"list-unsubscribe": "<mailto:x@y.z>"}


def mail(spark, sender="someone@post.example", subject="Agenda", labels=(), headers=None):
    return spark.createDataFrame([("m", sender, subject, list(labels), headers or {})], MAIL)


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, None),
        ({"subject": "Lunch at noon"}, None),
        ({"labels": ["STARRED"]}, None),
        ({"labels": ["CATEGORY_PROMOTIONS"]}, ("Ignore", "Agenda", "Ads", "rule")),
        ({"labels": ["CATEGORY_SOCIAL"]}, ("Ignore", "Agenda", "Ads", "rule")),
        ({"labels": ["INBOX", "SPAM"]}, ("Ignore", "Agenda", "Ads", "rule")),
        ({"headers": UNSUBSCRIBE}, ("Not Necessary", "Agenda", "Newsletter", "rule")),
        ({"headers": {"list-unsubscribe": ""}}, None),
        ({"headers": UNSUBSCRIBE, "labels": ["SPAM"]}, ("Ignore", "Agenda", "Ads", "rule")),
        ({"sender": "Office <desk@yourcompany.com>", "labels": ["CATEGORY_PROMOTIONS"]}, None),
        ({"sender": "a@sub.yourcompany.com", "labels": ["SPAM"]}, ("Ignore", "Agenda", "Ads", "rule")),
        ({"subject": "s" * 100, "labels": ["SPAM"]}, ("Ignore", "s" * 80, "Ads", "rule")),
    ],
)
def test_rule_cascade(spark, change, want):
    verdict = rules.apply_rules(mail(spark, **change)).first().verdict
    assert (verdict and tuple(verdict)) == want


def test_allowlist_table_equals_literals(spark):
    entries = ["@Corp.com", "boss@x.io", "@b@corp.com", "@x.io@y.io", "plain"]
    senders = ["A <a@corp.com>", "BOSS@x.io", "a@b@corp.com", "b@corp.com", "z@x.io@y.io", "q@y.io",
               "@corp.com", "plain", "", "a@corp.com.evil"]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(senders)], "id string, from_addr string")
    table = spark.createDataFrame([(e,) for e in entries + entries], "entry string")
    want = rows(df.select("id", rules.is_trusted(F.col("from_addr"), tuple(entries))), "id")
    assert rows(rules.trusted_by_table(df, table).select("id", "trusted"), "id") == want
    assert [w for _, w in want] == [True, True, True, True, True, False, True, True, False, False]


def test_allowlist_table_with_nulls_and_repeats(spark):
    senders = [("1", None), ("1", "x@corp.com"), ("2", "x@corp.com"), ("3", "y"), ("3", "y")]
    df = spark.createDataFrame(senders, "id string, from_addr string")
    table = spark.createDataFrame([("@corp.com",), (None,)], "entry string")
    got = rows(rules.trusted_by_table(df, table), "id", "from_addr")
    assert [t for *_, t in got] == [False, True, True, False, False]
    assert rules.trusted_by_table(df, table.limit(0)).where("trusted").count() == 0


def test_rules_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{\n "ignoreLabels": ["X"],\n "allowlist": []\n}')
    assert read_rules(spark, str(path)) == RuleConfig(("X",), ())


GOOD = '{"priority":"High","summary":"%s","label":"L"}'


@pytest.mark.parametrize(
    ("attempts", "want"),
    [
        ([(0, 200, GOOD % "a"), (2, 200, GOOD % "b")], ("High", "a", "L", "openrouter")),
        ([(0, 500, None), (1, 200, GOOD % "a")], ("High", "a", "L", "openrouter")),
        ([(0, 200, "junk"), (1, 200, GOOD % "a")], ("High", "a", "L", "openrouter")),
        ([(0, 404, None), (1, 200, GOOD % "a")], None),
        ([(0, 404, None), (1, 200, GOOD % "a"), (2, 200, GOOD % "b")], ("High", "b", "L", "openrouter")),
        ([(0, 500, None), (1, 429, None), (2, 400, None), (3, 200, GOOD % "x"), (4, 200, GOOD % "c")],
         ("High", "c", "L", "workers-ai")),
        ([(2, 503, None), (3, 200, GOOD % "d")], ("High", "d", "L", "openrouter")),
        ([(0, 500, GOOD % "not read")], None),
        ([(0, None, None), (1, 200, GOOD % "a")], ("High", "a", "L", "openrouter")),
    ],
)
def test_fallback_chain(spark, attempts, want):
    df = spark.createDataFrame([("m", *a) for a in attempts], scoring.ATTEMPT)
    got = scoring.resolve_attempts(df).first()
    assert tuple(got)[1:] == (want or tuple(scoring.FALLBACK.values()))


def test_prompt_rows_leave_out_ruled_mail(spark):
    df = mail(spark, labels=["SPAM"]).union(mail(spark).withColumn("id", F.lit("open")))
    full = (
        rules.apply_rules(df)
        .withColumn("body_text", F.lit("b"))
        .withColumn("snippet", F.lit(""))
        .withColumn("attachment_text", F.lit(""))
        .withColumn("images", F.array(F.lit("data:1"), F.lit("data:2")))
    )
    row = scoring.prompt_rows(full).collect()
    assert [(r.message_id, r.model) for r in row] == [("open", scoring.VISION_MODEL)]
    assert [p.type for p in row[0].parts] == ["text", "image_url", "image_url"]
    assert scoring.prompt_rows(full.withColumn("images", F.array().cast("array<string>"))).first().model == "openrouter/auto"

    def answer(prompts):
        return prompts.map(lambda p: '{"priority":"Critical","summary":"%d"}' % len(p))

    settled = scoring.classify(full, scoring.function_scorer(answer)).select("id", "verdict.priority", "verdict.method")
    assert rows(settled, "id") == [("m", "Ignore", "rule"), ("open", "Critical", "openrouter")]
    nobody = scoring.recorded_scorer(spark.createDataFrame([], scoring.ATTEMPT))
    settled = scoring.classify(full, nobody).select("id", "verdict.priority", "verdict.method")
    assert rows(settled, "id") == [("m", "Ignore", "rule"), ("open", "Medium", "fallback")]


def open_mail(spark, n):
    none = F.array().cast("array<string>")
    return spark.range(n).select(
        F.format_string("m%02d", "id").alias("id"), F.lit("a@b.example").alias("from_addr"),
        F.lit("s").alias("subject"), F.lit("").alias("snippet"), F.lit("t").alias("body_text"),
        F.lit("").alias("attachment_text"), F.lit(None).cast(rules.VERDICT).alias("verdict"),
        F.when(F.col("id") < 3, F.array(F.lit("data:1"))).otherwise(none).alias("images"),
        F.lit("x").alias("service"), (F.col("id") * 1000).alias("ts"),
    )


def test_chain_scorer(spark):
    """A refusal skips the second try, a row that raises costs itself only, the last model sees no image."""

    def call(rows):
        if (rows["message_id"] == "m01").any() and rows["model"].iloc[0] != scoring.LAST_MODEL:
            raise ValueError("m01")
        last = rows["model"] == scoring.LAST_MODEL
        summary = rows["model"].str[-4:] + rows["parts"].map(len).astype(str)
        status = 200 + 200 * ((rows["message_id"] == "m02") & ~last)
        return pd.DataFrame({"status": status, "content": summary.map(lambda x: GOOD % x)})

    tries = scoring.chain_scorer(call)(scoring.prompt_rows(open_mail(spark, 5)))
    ranks = tries.groupBy("message_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    got = rows(scoring.resolve_attempts(tries).join(ranks, "message_id").select("message_id", "summary", "ranks"), "message_id")
    last = scoring.LAST_MODEL[-4:] + "1"
    assert got == [("m00", scoring.VISION_MODEL[-4:] + "2", [0]), ("m01", last, [0, 1, 2, 3, 4]), ("m02", last, [0, 2, 4]),
                   ("m03", "auto1", [0]), ("m04", "auto1", [0])]


def test_no_call_is_made_that_the_limits_deny_for_sure(spark):
    asked = []

    def scorer(prompts):
        asked.append(sorted(r.message_id for r in prompts.collect()))
        return prompts.select("message_id", F.lit(0).alias("rank"), F.lit(200).alias("status"), F.lit(GOOD % "y").alias("content"))

    carry = spark.createDataFrame([("x", 3000, 0, 0)], "service string, open_until bigint, fails bigint, last_fail bigint")
    used = spark.createDataFrame([("x", 0, 1)], "service string, day bigint, used bigint")
    settled, _, now = scoring.classify_within_limits(open_mail(spark, 8), scorer, carry, used, quota=4)
    assert asked == [[f"m{i:02d}" for i in range(3, 6)]]  # no more than the day's quota has left
    assert rows(settled.select("id", "verdict.method"), "id") == [
        (f"m{i:02d}", "openrouter" if 3 <= i < 6 else "fallback") for i in range(8)
    ]
    assert rows(now) == [("x", 0, 4)]
    settled, _, _ = scoring.classify_within_limits(open_mail(spark, 8), scorer, carry, now, quota=4)
    assert len(asked) == 1 and settled.where("verdict.method = 'fallback'").count() == 8


def test_the_scorer_is_asked_in_waves(spark):
    """Verdicts as if all had been asked at once, with few calls in vain, however the calls end."""
    import random

    rng = random.Random(4)
    n, step = 90, 60_000
    good = [rng.random() < (0.97 if i < 55 else 0.3) for i in range(n)]
    subjects = spark.createDataFrame([(f"m{i:03d}", g, 1_700_000_000_000 + i * step) for i, g in enumerate(good)], "id string, good boolean, ts bigint")
    mail = subjects.select(
        "id", F.lit("a@b.example").alias("from_addr"), F.when(F.col("good"), "fine").otherwise("odd").alias("subject"),
        F.lit("").alias("snippet"), F.lit("").alias("body_text"), F.lit("").alias("attachment_text"),
        F.array().cast("array<string>").alias("images"), F.lit("scorer").alias("service"), "ts",
        F.lit(None).cast("struct<priority:string,summary:string,label:string,method:string>").alias("verdict"),
    )
    asked = []

    def scorer(prompts):
        asked.append(prompts.count())
        answer = F.when(F.contains("prompt", F.lit("fine")), GOOD % "x").otherwise("no answer")
        return prompts.select("message_id", F.lit(0).alias("rank"), F.lit(200).alias("status"), answer.alias("content"))

    carry = spark.createDataFrame([], limits.BREAKER_STATE)
    used = spark.createDataFrame([], limits.QUOTA_STATE)
    settled, states, now = scoring.classify_within_limits(mail, scorer, carry, used, quota=45, first_wave=12)
    calls = mail.join(subjects.select("id", F.col("good").alias("ok")), "id").select("service", "id", "ts", "ok")
    whole, want_states, want_used = scoring.apply_limits(calls, 45)
    outcome = {r.id: r.outcome for r in whole.collect()}
    got = {r.id: r.verdict.method for r in settled.collect()}
    assert got == {i: "openrouter" if o == "ok" else "fallback" for i, o in outcome.items()}
    assert rows(states.select(*want_states.columns)) == rows(want_states) and rows(now.select(*want_used.columns), "day") == rows(want_used, "day")
    effective = sum(o in ("ok", "failed") for o in outcome.values())
    assert effective > 45 and sum(asked) - effective < effective and len(asked) <= 12
