"""Scoring: prompt rows, attempts of the model chain, and the resolved verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import parse_answer
from ..functions.once import compute_once
from ..functions.text import prompt_text
from ..session import stage
from .limits import BREAKER_MS, DAILY_QUOTA, FAILURE_LIMIT, apply_limits, utc_day

# Method names, and the verdict when nothing answers.
METHOD_FIRST = "openrouter"
METHOD_LAST = "workers-ai"
FALLBACK = {
    "priority": "Medium",
    "summary": "Classification unavailable",
    "label": "Other",
    "method": "fallback",
}
# Model names by mail content, second model, last model.
TEXT_MODEL = "openrouter/auto"
VISION_MODEL = "google/gemini-2.0-flash-001"
SECOND_MODEL = "deepseek/deepseek-v4-flash"
LAST_MODEL = "@cf/meta/llama-3.3-70b-instruct-fp8-fast"

# Attempt ranks: first model 0 and 1, second model 2 and 3, last model 4.
FIRST_TRIES = (0, 2)
SECOND_TRIES = (1, 3)
LAST_RANK = 4

ATTEMPT = "message_id string, rank int, status int, content string"
Scorer = Callable[[DataFrame], DataFrame]
# Rows ``(message_id, model, prompt, parts)`` to ``(status, content)`` in the same order.
ModelCall = Callable[[pd.DataFrame], pd.DataFrame]


def model_name(images: Column) -> Column:
    return F.when(F.size(images) > 0, VISION_MODEL).otherwise(TEXT_MODEL)


def content_parts(prompt: Column, images: Column) -> Column:
    """Text first, then each image, as ``array<struct(type, text, url)>``."""
    text = F.array(
        F.struct(
            F.lit("text").alias("type"),
            prompt.alias("text"),
            F.lit(None).cast("string").alias("url"),
        )
    )
    pictures = F.transform(
        images,
        lambda url: F.struct(
            F.lit("image_url").alias("type"),
            F.lit(None).cast("string").alias("text"),
            url.alias("url"),
        ),
    )
    return F.concat(text, pictures)


def prompt_rows(mail: DataFrame) -> DataFrame:
    """``(message_id, prompt, model, parts)`` for mail the rules left open.

    Written as a filter in front of any scorer: Catalyst moves no filter past a Python
    scorer, so costly work only ever sees these rows.
    """
    prompt = prompt_text(
        F.col("from_addr"),
        F.col("subject"),
        F.col("body_text"),
        F.col("snippet"),
        F.col("attachment_text"),
    )
    return (
        mail.where(F.col("verdict").isNull())
        .select(F.col("id").alias("message_id"), prompt.alias("prompt"), "images")
        .select(
            "message_id",
            "prompt",
            model_name(F.col("images")).alias("model"),
            content_parts(F.col("prompt"), F.col("images")).alias("parts"),
        )
    )


def recorded_scorer(responses: DataFrame) -> Scorer:
    """Scorer over a table of recorded responses ``(message_id, rank, status, content)``."""

    def score(prompts: DataFrame) -> DataFrame:
        return prompts.select("message_id").join(responses, "message_id")

    return score


def function_scorer(answer: Callable[[pd.Series], pd.Series]) -> Scorer:
    """Scorer from a vectorised ``prompts -> answers`` function, run next to the data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "message_id": batch["message_id"],
                    "rank": pd.Series(0, index=batch.index, dtype="int32"),
                    "status": pd.Series(200, index=batch.index, dtype="int32"),
                    "content": answer(batch["prompt"]),
                }
            )

    return lambda prompts: prompts.select("message_id", "prompt").mapInPandas(run, ATTEMPT)


def chain_scorer(call: ModelCall) -> Scorer:
    """Scorer that asks live models, down the chain for as long as there is no usable answer.

    The mail's own model and then the second one get two tries each, the second try only if
    the first was not refused; the last model gets one, without images. Each try covers the
    messages that are still open and is written before the next, so that nothing is asked
    again when a later step repeats. A batch that raises is asked again row by row, and a row
    that raises counts as a failed try.
    """

    def score(prompts: DataFrame) -> DataFrame:
        waiting, refused, tries = prompts, None, []
        for rank in range(LAST_RANK + 1):
            tried = stage(_tried(_for_rank(waiting, rank), rank, call), "chain-try")
            tries.append(tried.select("message_id", "rank", "status", "content"))
            ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
            open_rows = tried.where(~ok | parse_answer(F.col("content")).isNull())
            if rank in FIRST_TRIES:
                no = F.coalesce(F.col("status").between(400, 499), F.lit(False))
                refused = open_rows.where(no).select(*prompts.columns)
                open_rows = open_rows.where(~no)
            waiting = open_rows.select(*prompts.columns)
            if rank in SECOND_TRIES:
                waiting = waiting.unionByName(refused)
        return reduce(DataFrame.unionByName, tries)

    return score


def _for_rank(waiting: DataFrame, rank: int) -> DataFrame:
    if rank == LAST_RANK:
        return waiting.withColumns({"model": F.lit(LAST_MODEL), "parts": F.slice("parts", 1, 1)})
    return waiting if rank < FIRST_TRIES[1] else waiting.withColumn("model", F.lit(SECOND_MODEL))


def _tried(waiting: DataFrame, rank: int, call: ModelCall) -> DataFrame:
    def one(row: pd.DataFrame) -> tuple[int | None, str | None]:
        try:
            answer = call(row).iloc[0]
        except Exception:
            return None, None
        return answer["status"], answer["content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = call(batch)[["status", "content"]]
            except Exception:
                found = [one(batch.iloc[i : i + 1]) for i in range(len(batch))]
                answers = pd.DataFrame(found, columns=["status", "content"])
            status = answers["status"].astype("Int32").to_numpy()
            yield batch.assign(status=status, content=answers["content"].to_numpy())

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema)
    tried = waiting.mapInPandas(run, f"{ddl}, status int, content string")
    return tried.withColumn("rank", F.lit(rank))


def keyword_scorer(keywords: dict[str, tuple[str, ...]]) -> Scorer:
    """Deterministic scorer: the first priority one of whose words is in the prompt."""

    def score(prompts: DataFrame) -> DataFrame:
        text = F.lower("prompt")
        chosen = F.lit(None).cast("string")
        for priority, words in reversed(list(keywords.items())):
            hit = F.lit(False)
            for word in words:
                hit = hit | F.contains(text, F.lit(word.lower()))
            chosen = F.when(hit, F.lit(priority)).otherwise(chosen)
        subject = F.regexp_extract("prompt", r"(?m)^Subject: (.*)$", 1)
        answer = F.to_json(
            F.struct(
                F.coalesce(chosen, F.lit("Low")).alias("priority"),
                subject.alias("summary"),
                F.lit("Keyword").alias("label"),
            )
        )
        return prompts.select(
            "message_id",
            F.lit(0).alias("rank"),
            F.lit(200).alias("status"),
            answer.alias("content"),
        )

    return score


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """First success per message, ``(message_id, priority, summary, label, method)``.

    A second try only counts if the first one of its model was not refused (4xx). One
    aggregation with a column per rank: partial results are built before the shuffle, so
    a message with very many attempt rows costs no more than any other.
    """
    ok = F.col("status").between(200, 299)
    answer = F.when(ok, parse_answer(F.col("content")))
    refused = F.col("status").between(400, 499)
    scored = compute_once(
        attempts.select("message_id", "rank", refused.alias("refused"), "status", "content"),
        answer=answer,
    ).drop("status", "content")

    def answer_at(rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("answer"))).alias(f"a{rank}")

    def refused_at(rank: int) -> Column:
        refused = (F.col("rank") == rank) & F.col("refused")
        return F.coalesce(F.bool_or(refused), F.lit(False)).alias(f"refused{rank}")

    by_rank = scored.groupBy("message_id").agg(
        *[answer_at(rank) for rank in range(LAST_RANK + 1)],
        *[refused_at(rank) for rank in FIRST_TRIES],
    )
    early = F.coalesce(
        F.col("a0"),
        F.when(~F.col("refused0"), F.col("a1")),
        F.col("a2"),
        F.when(~F.col("refused2"), F.col("a3")),
    )
    method = F.when(F.col("early").isNotNull(), METHOD_FIRST).when(
        F.col("answer").isNotNull(), METHOD_LAST
    )
    return (
        by_rank.withColumn("early", early)
        .withColumn("answer", F.coalesce("early", "a4"))
        .select(
            "message_id",
            *[
                F.coalesce(F.col("answer")[name], F.lit(FALLBACK[name])).alias(name)
                for name in ("priority", "summary", "label")
            ],
            F.coalesce(method, F.lit(FALLBACK["method"])).alias("method"),
        )
    )


def fallback_verdict() -> Column:
    return F.struct(*[F.lit(value).alias(name) for name, value in FALLBACK.items()])


def deny_over_limits(
    resolved: DataFrame,
    calls: DataFrame,
    quota: int = DAILY_QUOTA,
    limit: int = FAILURE_LIMIT,
    ttl_ms: int = BREAKER_MS,
) -> DataFrame:
    """Give the fallback to calls that an open breaker or a used-up quota would not make.

    ``resolved`` comes from ``resolve_attempts`` and says how each call would end;
    ``calls(message_id, service, ts)`` says when it is due.
    """
    due = resolved.join(calls, "message_id").select(
        "service",
        F.col("message_id").alias("id"),
        "ts",
        (F.col("method") != FALLBACK["method"]).alias("ok"),
    )
    outcomes = apply_limits(due, quota, limit, ttl_ms)[0]
    denied = outcomes.where(F.col("outcome").isin("open", "quota")).select(
        F.col("id").alias("message_id"), F.lit(True).alias("_denied")
    )
    return resolved.join(denied, "message_id", "left").select(
        "message_id",
        *[
            F.when(F.col("_denied"), F.lit(value)).otherwise(F.col(name)).alias(name)
            for name, value in FALLBACK.items()
        ],
    )


def classify(mail: DataFrame, scorer: Scorer) -> DataFrame:
    """Mail with ``verdict`` filled: rules first, then the scorer, else the fallback."""
    return _with_verdicts(mail, resolve_attempts(scorer(prompt_rows(mail))))


def _with_verdicts(mail: DataFrame, resolved: DataFrame) -> DataFrame:
    scored = resolved.select(
        F.col("message_id").alias("id"),
        F.struct("priority", "summary", "label", "method").alias("_scored"),
    )
    return (
        mail.join(scored, "id", "left")
        .withColumn("verdict", F.coalesce("verdict", "_scored", fallback_verdict()))
        .drop("_scored")
    )


def surely_denied(
    calls: DataFrame, carry: DataFrame, used: DataFrame, quota: int = DAILY_QUOTA
) -> DataFrame:
    """Of ``calls(service, id, ts)`` those that are denied however the others end.

    ``carry`` and ``used`` are what ``apply_limits`` left: a breaker that is open until after
    the call, or a day whose quota is used up.
    """
    spent = used.where(F.col("used") >= quota).select("service", "day", F.lit(True).alias("_spent"))
    dated = calls.withColumn("day", utc_day()).join(spent, ["service", "day"], "left")
    known = dated.join(carry.select("service", "open_until"), "service", "left")
    denied = F.coalesce("_spent", F.lit(False)) | F.coalesce(F.col("ts") < F.col("open_until"), F.lit(False))
    return known.where(denied).select("service", "id", "ts")


# Calls of the first wave of a service, and most waves before all that is left is asked at once.
FIRST_WAVE = 16
MOST_WAVES = 40


def classify_within_limits(
    mail: DataFrame,
    scorer: Scorer,
    carry: DataFrame,
    used: DataFrame,
    quota: int = DAILY_QUOTA,
    limit: int = FAILURE_LIMIT,
    ttl_ms: int = BREAKER_MS,
    first_wave: int = FIRST_WAVE,
    most_waves: int = MOST_WAVES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``classify`` for mail with ``service, ts``; also the breaker states and the days' use.

    The scorer is asked in waves, in the order of the calls, and every wave is folded before the
    next: what the limits deny by then is not asked. A wave takes no more calls of a day than its
    quota has left, so none is made in vain for the quota. For the breaker, which may open amid a
    wave, a service's wave has ``first_wave`` calls at first, twice as many after each wave without a
    call in vain, and ``first_wave`` again after one with some: between two of these, fewer calls are
    made in vain than ``first_wave`` and those made before with effect. Waves grow like powers of two,
    and their number stays below ``most_waves`` unless the breaker keeps opening; the last one asks
    all that is left.
    """
    left = stage(mail.where(F.col("verdict").isNull()).select("service", "id", "ts"), "due")
    sizes = carry.select("service", F.lit(first_wave).cast("bigint").alias("size")).limit(0)
    answers = []
    for wave in range(1, most_waves + 1):
        denied = surely_denied(left, carry, used, quota)
        left = stage(left.join(denied.select("id"), "id", "left_anti").select(*left.columns), "due-left")
        if left.isEmpty():
            break
        asked = left if wave == most_waves else _next_wave(left, used, sizes, quota, first_wave)
        asked = stage(asked, "wave")
        prompts = prompt_rows(mail.join(asked.select("id"), "id", "left_semi"))
        resolved = stage(resolve_attempts(scorer(prompts)), "resolved")
        ended = resolved.select(
            F.col("message_id").alias("id"), (F.col("method") != FALLBACK["method"]).alias("ok")
        )
        calls = asked.join(ended, "id", "left").fillna(False, "ok")
        limited, states, now_used = apply_limits(calls, quota, limit, ttl_ms, carry, used)
        limited = stage(limited, "wave-outcomes")
        made = F.col("outcome").isin("ok", "failed")
        answers.append(
            resolved.join(limited.where(made).select(F.col("id").alias("message_id")), "message_id", "left_semi")
        )
        idle = carry.join(states, "service", "left_anti")
        carry = stage(states.unionByName(idle.select(*states.columns)), "wave-states")
        used = stage(now_used, "wave-used")
        sizes = stage(_next_sizes(limited, sizes, made, first_wave), "wave-sizes")
        left = left.join(asked.select("id"), "id", "left_anti").select(*left.columns)
    none = resolve_attempts(mail.sparkSession.createDataFrame([], ATTEMPT))
    return _with_verdicts(mail, reduce(DataFrame.unionByName, answers, none)), carry, used


def _next_wave(left: DataFrame, used: DataFrame, sizes: DataFrame, quota: int, first_wave: int) -> DataFrame:
    """Of each service the first calls, up to its size and to the first day that lacks quota for more.

    Both ranks are cut at a constant before their shuffle, so a service with very many calls sends a
    few of them from each task.
    """
    most = max(first_wave, sizes.agg(F.max("size")).first()[0] or 0)
    in_order = Window.partitionBy("service").orderBy("ts", "id")
    ranked = left.withColumn("_rank", F.row_number().over(in_order)).where(F.col("_rank") <= most)
    in_day = Window.partitionBy("service", "day").orderBy("ts", "id")
    ranked = ranked.withColumn("day", utc_day()).withColumn("_of_day", F.row_number().over(in_day))
    ranked = ranked.join(used.select("service", "day", "used"), ["service", "day"], "left")
    ranked = ranked.join(sizes, "service", "left")
    over = (F.col("_of_day") > F.lit(quota) - F.coalesce("used", F.lit(0))).cast("int")
    ranked = ranked.withColumn("_over", F.max(over).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("_rank") <= F.coalesce("size", F.lit(first_wave))) & (F.col("_over") == 0)
    return ranked.where(fits).select(*left.columns)


def _next_sizes(limited: DataFrame, sizes: DataFrame, made: Column, first_wave: int) -> DataFrame:
    """Twice the size after a wave without a call in vain, else the first size: a row a service."""
    told = limited.groupBy("service").agg(F.bool_and(made).alias("clean")).join(sizes, "service", "full")
    size = F.coalesce("size", F.lit(first_wave).cast("bigint"))
    grown = F.when(F.col("clean").isNull(), size).when(F.col("clean"), 2 * size).otherwise(first_wave)
    return told.select("service", grown.cast("bigint").alias("size"))
