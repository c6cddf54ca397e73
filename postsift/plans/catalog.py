"""Registered batch queries: each runs an operator over a whole benchmark table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import parse_answer
from ..functions.clock import utc_day_key, utc_month_start
from ..functions.pdf import pdf_objects, pdf_text
from ..functions.priorities import priority_emoji, priority_number, priority_tag
from ..functions.text import (
    decode_base64url,
    is_account,
    message_link,
    normalise_account,
    redact,
    sender_address,
    sender_name,
    strip_html,
)
from ..operators import accounts as acc
from ..operators import digest, kept_stats, labels, limits, queue, ranking, routing, rules, scoring, state, stats
from ..session import configure, scratch_path, stage
from ..sources import attachments, feed, messages, push, tables
from ..tables.seen import SeenIds
from ..tables.versioned import VersionedTable
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Limits small enough to bind on the benchmark tables.
SMALL_CAP = 2
SMALL_QUOTA = 100
REPLAY_SINCE = fx.NOW_MS - 10 * 86_400_000


def query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    configured.__doc__ = run.__doc__
    QUERIES[run.__name__] = configured
    return configured


def joined(column: Column | str, separator: str = ",") -> Column:
    return F.array_join(column, separator)


# --- rules and routes ------------------------------------------------------------------


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(fx.mail(spark, sf_dir))


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail with a verdict: by rule, else by a stand-in for the scorer, a third each."""
    third = F.col("doc_id") % 3
    scored = F.struct(
        F.when(third == 0, "Critical").when(third == 1, "High").otherwise("Low").alias("priority"),
        F.concat(F.lit("Summary "), F.col("doc_id").cast("string")).alias("summary"),
        F.concat(F.lit("Label"), (F.col("doc_id") % 5).cast("string")).alias("label"),
        F.lit("openrouter").alias("method"),
    )
    return _ruled(spark, sf_dir).withColumn("verdict", F.coalesce("verdict", scored))


@query
def triage_summary(spark, sf_dir):
    ruled = _ruled(spark, sf_dir)
    verdict = F.coalesce("verdict", scoring.fallback_verdict())
    return (
        ruled.select(verdict.alias("verdict"))
        .select("verdict.priority", "verdict.label", "verdict.method")
        .withColumn("route", routing.route_of(F.col("priority")))
        .groupBy("priority", "label", "method", "route")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def rule_verdicts(spark, sf_dir):
    return _ruled(spark, sf_dir).select("id", "verdict.*")


@query
def trusted_senders(spark, sf_dir):
    trusted = rules.is_trusted(F.col("from_addr"), ("@yourcompany.com", "user7@plain.example"))
    return fx.mail(spark, sf_dir).where(trusted).select("id", "from_addr")


@query
def trusted_senders_by_table(spark, sf_dir):
    """Allowlist table: every tenth customer's domain or address."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    entries = customers.selectExpr(
        "CASE WHEN c_custkey % 2 = 0 THEN '@example' || c_custkey % 40 || '.com' "
        "ELSE 'User' || c_custkey % 40 || '@plain.example' END AS entry"
    ).union(spark.sql("SELECT '@YourCompany.com'"))
    mail = fx.read_view(spark, sf_dir, "fx_mail").select("id", "from_addr")
    return rules.trusted_by_table(mail, entries)


@query
def ignored_labels(spark, sf_dir):
    config = rules.RuleConfig()
    hit = rules.has_ignored_label(F.col("labels"), config.ignore_labels)
    return fx.mail(spark, sf_dir).where(hit).select("id", "label_csv")


@query
def newsletters(spark, sf_dir):
    return fx.mail(spark, sf_dir).where(rules.is_newsletter(F.col("headers"))).select("id")


@query
def routes(spark, sf_dir):
    return routing.add_route(_settled(spark, sf_dir)).select("id", "verdict.priority", "route")


@query
def immediate_notifications(spark, sf_dir):
    mail = _settled(spark, sf_dir).where("verdict.priority = 'Critical'")
    sent = routing.immediate_notifications(mail)
    return sent.withColumn("tags", joined("tags")).withColumn("markdown", F.col("markdown").cast("int"))


@query
def mailbox_actions(spark, sf_dir):
    actions = routing.mailbox_actions(_settled(spark, sf_dir))
    return actions.select(
        "id", joined("add_labels").alias("add_labels"), joined("remove_labels").alias("remove_labels")
    )


@query
def labelled_actions(spark, sf_dir):
    """Mailbox actions by label id, missing labels created first."""
    mail = _settled(spark, sf_dir).withColumn("label", F.col("verdict.label"))
    actions = routing.mailbox_actions(labels.with_label_id(mail, _labels(mail)))
    return actions.select(
        "id", joined("add_labels").alias("add_labels"), joined("remove_labels").alias("remove_labels")
    )


def _finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = F.concat(F.lit("bad: "), F.repeat(F.concat(F.lit("part of "), "id", F.lit("; ")), F.lit(30)))
    error = F.when(F.col("doc_id") % 9 == 0, what)
    return _settled(spark, sf_dir).select(
        "id",
        "verdict",
        (F.col("received_at") + F.col("doc_id") % 1000).alias("finished_at"),
        (F.col("doc_id") % 77).alias("duration_ms"),
        error.alias("error"),
    )


@query
def processing_log(spark, sf_dir):
    """The log lines, read back as JSON."""
    fields = (
        "ts string, level string, event string, messageId string, priority string, "
        "label string, method string, durationMs bigint, error string"
    )
    lines = routing.processing_log(_finished(spark, sf_dir))
    read = lines.select("id", F.from_json("line", fields).alias("l"))
    return read.select("id", "l.*").withColumnsRenamed(
        {"messageId": "message_id", "durationMs": "duration_ms"}
    )


@query
def failure_alerts(spark, sf_dir):
    alerts = routing.failure_alerts(_finished(spark, sf_dir))
    return alerts.select("id", "message", "priority", joined("tags").alias("tags"))


# --- text ------------------------------------------------------------------------------


@query
def sender_fields(spark, sf_dir):
    sender = F.col("from_addr")
    return fx.read_view(spark, sf_dir, "fx_mail").select(
        "id",
        sender_address(sender).alias("address"),
        sender_name(sender).alias("name"),
        message_link(F.col("id")).alias("link"),
    )


@query
def html_stripped(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", strip_html(F.col("html")).alias("text")).select(
        "page_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars")
    )


def _redacted(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    rows = fx.read_view(spark, sf_dir, "fx_mail")
    text = redact(F.col("body"), profile)
    return rows.select("id", text.alias("text")).select(
        "id",
        F.md5("text").alias("digest"),
        F.length("text").alias("n_chars"),
        F.left(F.col("text"), F.lit(2048)).alias("body_text"),
    )


@query
def text_redacted(spark, sf_dir):
    return _redacted(spark, sf_dir, "reference")


@query
def text_redacted_extended(spark, sf_dir):
    return _redacted(spark, sf_dir, "extended")


@query
def parsed_answers(spark, sf_dir):
    attempts = fx.read_view(spark, sf_dir, "fx_attempt")
    parsed = attempts.select("message_id", "rank", parse_answer(F.col("content")).alias("a"))
    return parsed.select("message_id", "rank", "a.*")


@query
def priority_dimension(spark, sf_dir):
    priority = F.col("priority")
    return (
        fx.pending(spark, sf_dir)
        .groupBy("priority")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "priority",
            "n",
            priority_number(priority).alias("number"),
            priority_tag(priority).alias("tag"),
            priority_emoji(priority).alias("emoji"),
        )
    )


@query
def daily_arrivals(spark, sf_dir):
    at = F.col("received_at")
    return (
        fx.pending(spark, sf_dir)
        .groupBy(utc_day_key(at).alias("day"), utc_month_start(at).alias("month_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- sources ---------------------------------------------------------------------------


@query
def push_envelopes(spark, sf_dir):
    pushes = fx.read_view(spark, sf_dir, "fx_push")
    return push.decode_envelopes(pushes).select(
        "event_id", "push_id", "account", "history_id", "reject_reason"
    )


@query
def push_quarantine(spark, sf_dir):
    decoded = push.decode_envelopes(fx.read_view(spark, sf_dir, "fx_push"))
    return (
        push.quarantined(decoded).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    )


def _feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = feed.parse_pages(fx.feed_pages(spark, sf_dir))
    plan = feed.plan_sync(*fx.feed_accounts(spark, sf_dir))
    mailbox = (
        fx.read_view(spark, sf_dir, "fx_feed")
        .where("message_id IS NOT NULL")
        .groupBy("account", "message_id")
        .agg(F.max("received_at").alias("received_at"))
    )
    return pages, plan, mailbox


@query
def feed_plan(spark, sf_dir):
    return _feed(spark, sf_dir)[1]


@query
def feed_scan(spark, sf_dir):
    pages, plan, _ = _feed(spark, sf_dir)
    return feed.scan_feed(pages, plan)


@query
def feed_cursors(spark, sf_dir):
    pages, plan, _ = _feed(spark, sf_dir)
    notified = fx.read_view(spark, sf_dir, "fx_feed").select(
        "account",
        F.col("entry_id").cast("string").alias("history_id"),
        F.col("entry_id").alias("ts"),
    )
    return feed.next_cursors(pages, plan, notified)


@query
def feed_fallback(spark, sf_dir):
    _, plan, mailbox = _feed(spark, sf_dir)
    return feed.scan_fallback(mailbox, plan, fx.NOW_MS)


@query
def feed_incoming(spark, sf_dir):
    pages, plan, mailbox = _feed(spark, sf_dir)
    seen = fx.processed_messages(spark, sf_dir)
    return feed.incoming_ids(pages, mailbox, plan, seen, fx.NOW_MS).select("account", "message_id")


@query
def feed_incoming_indexed(spark, sf_dir):
    """The same against an index of processed ids, made of three inserts."""
    pages, plan, mailbox = _feed(spark, sf_dir)
    seen = SeenIds(spark, scratch_path(spark, "seen"))
    processed = fx.processed_messages(spark, sf_dir).where("message_id IS NOT NULL")
    rows = stage(processed.selectExpr("message_id AS id", "processed_at AS seen_at"), "processed")
    for part in range(3):
        seen.add(rows.where(F.pmod(F.hash("id"), F.lit(3)) == part))
    return feed.incoming_ids(pages, mailbox, plan, seen, fx.NOW_MS).select("account", "message_id")


@query
def account_syncs(spark, sf_dir):
    """Notifications with the cursor of their account."""
    _, cursors, _ = fx.feed_accounts(spark, sf_dir)
    notes = fx.read_view(spark, sf_dir, "fx_notification")
    return notes.join(cursors, "account", "left").select("event_id", "account", "cursor")


def _parsed(spark: SparkSession, sf_dir: str, charset: str = "ISO-8859-1") -> DataFrame:
    raw = fx.provider_messages(spark, sf_dir).select("doc_id", "message")
    return messages.parse_messages(raw, charset=charset)


@query
def message_fields(spark, sf_dir):
    header = F.try_element_at("headers", F.lit("list-unsubscribe"))
    return _parsed(spark, sf_dir).select(
        "doc_id",
        "id",
        "thread_id",
        "from_addr",
        "subject",
        "snippet",
        "date",
        joined("labels").alias("label_csv"),
        header.alias("unsubscribe"),
        F.size("nodes").alias("n_nodes"),
        "reject_reason",
    )


@query
def message_bodies(spark, sf_dir):
    """Bodies as they have to be matched: UTF-8 read as Latin-1."""
    return _parsed(spark, sf_dir).select("doc_id", F.md5("body_text").alias("digest"))


@query
def message_bodies_utf8(spark, sf_dir):
    return _parsed(spark, sf_dir, "UTF-8").select("doc_id", F.md5("body_text").alias("digest"))


@query
def mime_parts(spark, sf_dir):
    parts = messages.mime_parts(_parsed(spark, sf_dir).where("reject_reason IS NULL"))
    return parts.select(
        "message_id",
        joined(F.col("path").cast("array<string>"), ".").alias("path"),
        "mime_type",
        "filename",
        "content_id",
        "size",
        "attachment_id",
        F.col("is_container").cast("int").alias("is_container"),
    )


@query
def first_content_ids(spark, sf_dir):
    read = _parsed(spark, sf_dir).where("reject_reason IS NULL")
    leaves = read.select("id", attachments.attachment_leaves(F.col("nodes")).alias("leaves"))
    first = attachments.first_of_content_id(F.col("leaves"))
    kept = leaves.select("id", F.explode(first).alias("n"))
    return kept.select("id", joined(F.col("n.path").cast("array<string>"), ".").alias("path"))


@query
def attachment_bytes(spark, sf_dir):
    parts = messages.mime_parts(_parsed(spark, sf_dir).where("reject_reason IS NULL"))
    leaves = parts.where("NOT is_container")
    found = attachments.fetch_bytes(leaves, fx.attachment_store(spark, sf_dir))
    return found.select(
        "message_id",
        joined(F.col("path").cast("array<string>"), ".").alias("path"),
        F.md5("bytes").alias("digest"),
    )


def _attached(spark: SparkSession, sf_dir: str, charset: str = "ISO-8859-1") -> DataFrame:
    read = _parsed(spark, sf_dir, charset).where("reject_reason IS NULL")
    return attachments.with_attachments(read, fx.attachment_store(spark, sf_dir))


@query
def message_images(spark, sf_dir):
    return _attached(spark, sf_dir).select("id", joined("images", " ").alias("images"))


@query
def attachment_text(spark, sf_dir):
    return _attached(spark, sf_dir).select("id", F.col("attachment_text").alias("text"))


@query
def pdf_texts(spark, sf_dir):
    store = fx.attachment_store(spark, sf_dir).where("attachment_id = 'pdf'")
    objects = store.select("message_id", pdf_objects(decode_base64url(F.col("data"))).alias("o"))
    return objects.select("message_id", pdf_text(F.col("o"), F.lit(2000)).alias("text"))


@query
def prompts(spark, sf_dir):
    attached = _attached(spark, sf_dir, "UTF-8")
    mail = attached.withColumn("verdict", F.lit(None).cast(rules.VERDICT))
    rows = scoring.prompt_rows(mail)
    return rows.select("message_id", "prompt", "model", F.size("parts").alias("n_parts"))


# --- scoring and limits ----------------------------------------------------------------


@query
def resolved_attempts(spark, sf_dir):
    return scoring.resolve_attempts(fx.read_view(spark, sf_dir, "fx_attempt"))


@query
def classified_mail(spark, sf_dir):
    """Rules, then recorded answers, then the fallback, for every mail."""
    recorded = fx.read_view(spark, sf_dir, "fx_attempt").withColumn(
        "message_id", F.concat(F.lit("msg"), F.substring("message_id", 2, 20))
    )
    none = F.array().cast("array<string>")
    mail = _ruled(spark, sf_dir).select(
        "id", "from_addr", "subject", "snippet", "verdict", F.col("body").alias("body_text"),
        F.lit("").alias("attachment_text"), none.alias("images"),
    )
    settled = scoring.classify(mail, scoring.recorded_scorer(recorded))
    return settled.select("id", "verdict.*")


@query
def keyword_scores(spark, sf_dir):
    words = {"Critical": ("verification code",), "High": ("ssn", "card"), "Medium": ("bearer",)}
    none = F.array().cast("array<string>")
    mail = _ruled(spark, sf_dir).select(
        "id", "from_addr", "subject", "snippet", "verdict",
        F.col("body").alias("body_text"),
        F.lit("").alias("attachment_text"), none.alias("images"),
    )
    scored = scoring.resolve_attempts(scoring.keyword_scorer(words)(scoring.prompt_rows(mail)))
    return scored.select("message_id", "priority", "label", "method")


def _planted_call(rows):
    """Answers with the model's name; some messages are refused, fail, get no JSON or raise."""
    number = rows["message_id"].str[3:].astype("int64")
    model = rows["model"].iloc[0]
    if model == scoring.SECOND_MODEL:
        refused, failed, junk, raised = number % 4 == 0, number < 0, number < 0, number % 4 == 1
    elif model == scoring.LAST_MODEL:
        refused, failed, junk, raised = number < 0, number % 5 == 0, number < 0, number < 0
    else:
        refused, failed, junk, raised = (number % 6 == i for i in range(4))
    if raised.any():
        raise ValueError("planted")
    answer = '{"priority":"High","summary":"%s","label":"Chain"}' % model
    status = np.select([refused, failed], [429, 503], 200)
    return pd.DataFrame({"status": status, "content": np.where(junk, "no answer", answer)})


@query
def scored_chain(spark, sf_dir):
    """The live chain over all mail the rules left open, and its tries."""
    none = F.array().cast("array<string>")
    mail = _ruled(spark, sf_dir).select(
        "id", "from_addr", "subject", "snippet", "verdict", F.col("body").alias("body_text"),
        F.lit("").alias("attachment_text"), none.alias("images"),
    )
    tries = scoring.chain_scorer(_planted_call)(scoring.prompt_rows(mail))
    counted = tries.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_tries"))
    return scoring.resolve_attempts(tries).join(counted, "message_id")


@query
def daily_classifications(spark, sf_dir):
    return stats.daily_classifications(_results(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = scoring.resolve_attempts(fx.read_view(spark, sf_dir, "fx_attempt"))
    calls = fx.read_view(spark, sf_dir, "fx_call")
    at = calls.groupBy(F.expr("'m' || id div 5").alias("message_id")).agg(F.min("ts").alias("ts"))
    return resolved.join(at, "message_id")


@query
def limited_verdicts(spark, sf_dir):
    """Resolved answers, but the fallback where a limit would not allow the call."""
    attempts = fx.read_view(spark, sf_dir, "fx_attempt")
    calls = (
        fx.read_view(spark, sf_dir, "fx_call")
        .groupBy(F.expr("'m' || id div 5").alias("message_id"), "service")
        .agg(F.min("ts").alias("ts"))
    )
    resolved = scoring.resolve_attempts(attempts)
    return scoring.deny_over_limits(resolved, calls, quota=20, ttl_ms=7_200_000)


@query
def quota_denials(spark, sf_dir):
    calls = fx.read_view(spark, sf_dir, "fx_call")
    limited = limits.apply_quota(calls, SMALL_QUOTA)
    return limited.where(~F.col("in_quota")).select("id", "day")


@query
def breaker_calls(spark, sf_dir):
    calls = fx.read_view(spark, sf_dir, "fx_call")
    folded, _ = limits.apply_breaker(calls)
    return folded.select(
        "id", F.col("attempted").cast("int").alias("attempted"), F.col("tripped").cast("int").alias("tripped")
    )


@query
def limited_calls(spark, sf_dir):
    calls = fx.read_view(spark, sf_dir, "fx_call")
    return limits.apply_limits(calls, quota=SMALL_QUOTA)[0].select("id", "outcome")


# --- queue -----------------------------------------------------------------------------


@query
def queue_inserts(spark, sf_dir):
    """New mail, some with an id the queue knows, and every id twice."""
    settled = _settled(spark, sf_dir).withColumn("id", F.expr("'e' || doc_id * 20"))
    twice = settled.unionByName(settled.withColumn("received_at", F.col("received_at") + 1))
    return queue.enqueue(fx.pending(spark, sf_dir), twice)


@query
def queue_oldest(spark, sf_dir):
    oldest = queue.oldest_unsent(fx.pending(spark, sf_dir))
    return oldest.select("id", "priority", "pos", "chunk")


@query
def queue_chunks(spark, sf_dir):
    """Position and chunk of every unsent row, not only of the next flush."""
    unsent = queue.unsent(fx.pending(spark, sf_dir)).select("id", "priority", "received_at")
    placed = ranking.positions(unsent, ["priority"], ["received_at", "id"])
    return placed.select("id", "priority", "pos", queue.chunk_of(F.col("pos")).alias("chunk"))


@query
def flush_windows(spark, sf_dir):
    return queue.flush_windows(fx.pending(spark, sf_dir))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.assign_flush(fx.pending(spark, sf_dir), SMALL_CAP)


@query
def flush_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", "priority", "pos", "sent_tick", "flush_at")


@query
def mark_sent(spark, sf_dir):
    ids = fx.pending(spark, sf_dir).where("priority = 'Low'").select("id")
    return queue.mark_sent(fx.pending(spark, sf_dir), ids, fx.NOW_MS).select("id", "sent_at")


@query
def replayed(spark, sf_dir):
    return queue.replay(fx.pending(spark, sf_dir), REPLAY_SINCE).select("id", "sent_at")


@query
def replayed_rows(spark, sf_dir):
    return queue.replayed_rows(fx.pending(spark, sf_dir), REPLAY_SINCE)


@query
def retained_pending(spark, sf_dir):
    return queue.retain_pending(fx.pending(spark, sf_dir), fx.NOW_MS).select("id")


@query
def retained_processed(spark, sf_dir):
    return queue.retain_processed(fx.processed_messages(spark, sf_dir), fx.NOW_MS)


@query
def versioned_queue(spark, sf_dir):
    """The queue as a versioned table: inserted, marked, replayed and retained, bucket by bucket."""
    rows = stage(fx.pending(spark, sf_dir), "pending")
    table = VersionedTable(spark, scratch_path(spark, "queue"), tables.PENDING, "id")
    table.insert(rows)
    ids = rows.where("priority = 'Low'").select("id")
    table.update(ids, lambda old, low: queue.mark_sent(old, low, REPLAY_SINCE - 1))
    table.rewrite_where(queue.needs_replay(REPLAY_SINCE), lambda old: queue.replay(old, REPLAY_SINCE))
    old_marks = F.col("sent_at") < fx.NOW_MS - queue.SENT_MEMORY_MS
    table.rewrite_where(old_marks, lambda old: queue.retain_pending(old, fx.NOW_MS))
    return table.read().select("id", "sent_at")


@query
def processed_inserts(spark, sf_dir):
    """Insert-or-ignore of every message of the feed into the processed table."""
    new = (
        fx.read_view(spark, sf_dir, "fx_feed")
        .where("message_id IS NOT NULL")
        .select("message_id", F.col("received_at").alias("processed_at"))
    )
    old = fx.processed_messages(spark, sf_dir).withColumn("processed_at", F.lit(0).cast("bigint"))
    return queue.insert_ignore(old, new, "message_id", ["processed_at"])


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old state of some accounts, and every notification as a change."""
    notes = fx.read_view(spark, sf_dir, "fx_notification")
    key = F.concat(F.lit(state.CURSOR_PREFIX), F.col("account")).alias("key")
    value = F.col("history_id").alias("value")
    changes = notes.select(key, value, F.col("ts").alias("updated_at"))
    old = notes.where("account < 'box4'").groupBy(key).agg(
        F.lit("old").alias("value"), F.lit(1).cast("bigint").alias("updated_at")
    )
    return old, changes


@query
def state_upserts(spark, sf_dir):
    return state.upsert(*_state(spark, sf_dir))


@query
def state_inserts(spark, sf_dir):
    old, changes = _state(spark, sf_dir)
    return state.insert_absent(old, changes)


@query
def state_lookups(spark, sf_dir):
    old, _ = _state(spark, sf_dir)
    asked = fx.read_view(spark, sf_dir, "fx_feed").select(
        F.concat(F.lit(state.CURSOR_PREFIX), F.col("account")).alias("key")
    )
    found = state.lookup(asked, old)
    return found.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


# --- digests and delivery --------------------------------------------------------------


@query
def digest_groups(spark, sf_dir):
    groups = digest.sender_groups(queue.oldest_unsent(fx.pending(spark, sf_dir)), ("priority",))
    ids = F.transform("rows", lambda r: r["id"])
    return groups.select("priority", "chunk", "name", "first_pos", "n", joined(ids).alias("ids"))


def _flat(digests: DataFrame) -> DataFrame:
    return digests.withColumn("tags", joined("tags")).drop("markdown")


@query
def digest_rows(spark, sf_dir):
    return _flat(digest.digests(queue.oldest_unsent(fx.pending(spark, sf_dir))))


@query
def digest_history(spark, sf_dir):
    """The digests of every tick that ever flushed, with the default cap."""
    assigned = queue.assign_flush(fx.pending(spark, sf_dir))
    return _flat(digest.digests(digest.tick_flushes(assigned), ("priority", "sent_tick")))


@query
def deliveries(spark, sf_dir):
    notes = digest.digests(queue.oldest_unsent(fx.pending(spark, sf_dir))).select(
        "chunk", "title", F.col("priority_number").alias("priority")
    )
    return digest.deliveries(notes)


@query
def server_bodies(spark, sf_dir):
    """The JSON bodies of the next flush's digests, read back field by field."""
    rows = digest.digests(queue.oldest_unsent(fx.pending(spark, sf_dir)))
    body = digest.server_payload(F.col("title"), F.col("message"), F.col("priority_number"))
    fields = "title string, message string, priority int, extras string"
    read = rows.select("chunk", F.from_json(body, fields).alias("b"))
    return read.select("chunk", "b.title", "b.message", F.col("b.priority").alias("server_priority"), "b.extras")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven delivery attempts per payload, of which only the first four may count."""
    return fx.read_view(spark, sf_dir, "fx_call").select(
        F.expr("id div 7").alias("payload_id"), F.expr("id % 7").alias("attempt_no"), "ok"
    )


@query
def delivery_outcomes(spark, sf_dir):
    outcome = digest.delivery_outcome(_attempts(spark, sf_dir))
    return outcome.select("payload_id", F.col("delivered").cast("int").alias("delivered"))


@query
def delivered_marks(spark, sf_dir):
    """Only the rows of delivered chunks are marked; chunk 1 of every queue fails."""
    pending = fx.pending(spark, sf_dir)
    flush = queue.oldest_unsent(pending)
    outcome = flush.select("priority", "chunk").distinct().withColumn("delivered", F.col("chunk") != 1)
    ids = digest.delivered_ids(flush, outcome)
    return queue.mark_sent(pending, ids, fx.NOW_MS).select("id", "sent_at")


@query
def label_ids(spark, sf_dir):
    """Labels per account: known for odd label numbers, created for the others."""
    mail = _settled(spark, sf_dir).select("id", "account", "verdict.label")
    return labels.with_label_id(mail, _labels(mail)).select("id", "account", "label", "label_id")


def _labels(mail: DataFrame) -> DataFrame:
    known = mail.where("label IN ('Label1', 'Label3')").select(
        "account", F.concat(F.lit("AI/"), F.col("label")).alias("name")
    ).distinct().withColumn("label_id", F.concat(F.lit("known-"), F.col("name")))
    return labels.get_or_create_labels(mail.select("account", "label"), known)


# --- statistics and accounts -----------------------------------------------------------


@query
def processed_counts(spark, sf_dir):
    return stats.processed_counts(fx.processed_messages(spark, sf_dir), fx.NOW_MS)


@query
def pending_counts(spark, sf_dir):
    """Unsent rows per priority; rows of Low count as Medium here, so that one queue is empty."""
    moved = F.when(F.col("priority") == "Low", "Medium").otherwise(F.col("priority"))
    return stats.pending_counts(fx.pending(spark, sf_dir).withColumn("priority", moved))


@query
def kept_pending_counts(spark, sf_dir):
    """Unsent rows per priority, kept while the queue is filled, marked, replayed and retained."""
    rows = stage(fx.pending(spark, sf_dir), "pending")
    table = VersionedTable(spark, scratch_path(spark, "queue"), tables.PENDING, "id")
    kept = kept_stats.KeptPending(table, scratch_path(spark, "counts"))
    table.insert(rows)
    kept.refresh()
    low = rows.where("priority = 'Low'").select("id")
    told = []

    def tell(step: str) -> None:
        kept.refresh()
        told.append(kept.by_priority().select(F.lit(step).alias("step"), "priority", "n"))

    table.update(low, lambda old, ids: queue.mark_sent(old, ids, REPLAY_SINCE - 1))
    tell("marked")
    table.rewrite_where(queue.needs_replay(REPLAY_SINCE), lambda old: queue.replay(old, REPLAY_SINCE))
    tell("replayed")
    old_marks = F.col("sent_at") < fx.NOW_MS - queue.SENT_MEMORY_MS
    table.rewrite_where(old_marks, lambda old: queue.retain_pending(old, fx.NOW_MS))
    tell("retained")
    return told[0].unionByName(told[1]).unionByName(told[2])


# Times the kept counts are asked for: on a full hour, and not.
ASKED_AT = [fx.NOW_MS, fx.NOW_MS - 3 * 86_400_000, fx.NOW_MS - 3 * 86_400_000 + 1_234_567]


@query
def kept_processed_counts(spark, sf_dir):
    """Messages processed in a day and a month at several times, kept while rows come and go."""
    rows = stage(fx.processed_messages(spark, sf_dir), "processed")
    path = scratch_path(spark, "processed")
    table = VersionedTable(spark, path, tables.PROCESSED_MESSAGES, "message_id")
    kept = kept_stats.KeptProcessed(table, scratch_path(spark, "counts"))
    half = F.pmod(F.xxhash64("message_id"), F.lit(2))
    table.insert(rows.where(half == 0))
    kept.refresh()
    table.insert(rows.where(half == 1))
    memory = 20 * 86_400_000
    old = F.col("processed_at") < fx.NOW_MS - memory
    table.rewrite_where(old, lambda held: queue.retain_processed(held, fx.NOW_MS, memory))
    kept.refresh()
    asked = [kept.at(now).select(F.lit(now).cast("bigint").alias("asked_at"), "*") for now in ASKED_AT]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


@query
def kept_daily_classifications(spark, sf_dir):
    """Scored calls per day, kept as results come in."""
    results = stage(_results(spark, sf_dir), "results")
    path = scratch_path(spark, "results")
    table = VersionedTable(spark, path, "message_id string, ts bigint, method string", "message_id")
    kept = kept_stats.KeptDaily(table, scratch_path(spark, "counts"))
    for part in range(2):
        table.insert(results.where(F.pmod(F.xxhash64("message_id"), F.lit(2)) == part))
        kept.refresh()
    return kept.by_day()


@query
def stored_queue(spark, sf_dir):
    """The queue, written as a table and read with its stated schema."""
    path = scratch_path(spark, "tables")
    fx.pending(spark, sf_dir).write.parquet(path)
    return tables.read_table(spark, path, "pending_emails")


@query
def configured_rules(spark, sf_dir):
    """Rule verdicts under a rules file with an entry for each of the customers' 20 groups."""
    path = scratch_path(spark, "rules")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    entry = F.expr(
        "CASE WHEN c_custkey % 20 < 10 THEN '@example' || c_custkey % 20 || '.com' "
        "ELSE 'user' || c_custkey % 20 || '@plain.example' END"
    )
    customers.agg(
        F.array_sort(F.collect_set(entry)).alias("allowlist"), F.array(F.lit("SPAM")).alias("ignoreLabels")
    ).write.json(path)
    config = tables.read_rules(spark, path)
    return rules.apply_rules(fx.mail(spark, sf_dir), config).select("id", "verdict.priority", "verdict.label")


@query
def recent_pending(spark, sf_dir):
    return stats.recent_pending(fx.pending(spark, sf_dir))


@query
def recent_processed(spark, sf_dir):
    return stats.recent_processed(fx.processed_messages(spark, sf_dir))


@query
def recent_history(spark, sf_dir):
    history = (
        fx.read_view(spark, sf_dir, "fx_notification")
        .groupBy("history_id")
        .agg(F.min("ts").alias("processed_at"))
    )
    return stats.recent_history(history)


@query
def accounts_normalised(spark, sf_dir):
    requests = fx.read_view(spark, sf_dir, "fx_account_request")
    email = normalise_account(F.col("email"))
    return requests.select("added_at", email.alias("email"), is_account(email).cast("int").alias("valid"))


@query
def accounts_added(spark, sf_dir):
    known = fx.read_view(spark, sf_dir, "fx_account")
    return acc.add_accounts(known, fx.read_view(spark, sf_dir, "fx_account_request"))


@query
def accounts_removed(spark, sf_dir):
    known = fx.read_view(spark, sf_dir, "fx_account").select("email", "added_at")
    return acc.remove_accounts(known, fx.read_view(spark, sf_dir, "fx_account_request"))


@query
def accounts_listed(spark, sf_dir):
    known = fx.read_view(spark, sf_dir, "fx_account")
    real = known.where("email <> '__primary__'")
    expiry = real.where("nation < 10").select("email", (F.col("key") * 10).alias("watch_expiry"))
    webhook = real.where("nation > 5").select("email", (F.col("key") + 7).alias("last_webhook"))
    return acc.list_accounts(known, expiry, webhook)
