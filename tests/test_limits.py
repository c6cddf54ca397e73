from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from postsift.operators import limits
from postsift.operators.ranking import ordered_runs
from postsift.operators.limits import BreakerState, _Piece, compose, leave, summarise_piece

DAY = 86_400_000


def simulate(calls, quota=10**9, limit=3, ttl=300_000):
    """One call after the other: ``{(service, id): outcome}``."""
    out, state = {}, {}
    for service, rid, ts, ok in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        s = state.setdefault(service, {"open": 0, "fails": 0, "last": 0, "used": {}})
        used = s["used"].get(ts // DAY, 0)
        if ts < s["open"]:
            outcome = "open"
        elif used >= quota:
            outcome = "quota"
        elif ok:
            outcome, s["fails"] = "ok", 0
            s["used"][ts // DAY] = used + 1
        else:
            outcome = "failed"
            s["fails"] = s["fails"] + 1 if s["fails"] and ts - s["last"] < ttl else 1
            s["last"] = ts
            if s["fails"] >= limit:
                s["open"], s["fails"] = ts + ttl, 0
        out[service, rid] = outcome
    return out


def history(seed, n, services=("a",), step=(1, 60_000), p_ok=0.5, start=1_704_067_200_000):
    random.seed(seed)
    ts, calls = start, []
    for i in range(n):
        ts += random.choice([0, 0, random.randint(*step)])
        calls.append((random.choice(services), i, ts, random.random() < p_ok))
    return calls


def table(spark, calls):
    return spark.createDataFrame(calls, "service string, id bigint, ts bigint, ok boolean").repartition(5)


def outcomes(df):
    return {(r.service, r.id): r.outcome for r in df.collect()}


@pytest.mark.parametrize("seed", range(200))
def test_pieces_compose(seed):
    random.seed(seed)
    limit, ttl = random.choice([1, 2, 3, 4]), random.choice([3, 10, 30])
    n = random.randint(1, 60)
    ts = np.cumsum([random.choice([0, 0, 1, 1, 2, 5, 12, 40]) for _ in range(n)]) + 1000
    ok = np.array([random.random() < random.choice([0.1, 0.5, 0.9]) for _ in range(n)])
    want = simulate([("a", i, int(t), bool(o)) for i, (t, o) in enumerate(zip(ts, ok))], limit=limit, ttl=ttl)
    cuts = sorted({0, n, *(random.randint(0, n) for _ in range(random.randint(0, 8)))})
    state, got, summaries, entries, oks = BreakerState(), [], [], [], []
    most = random.choice([2, 5, 100])
    for begin, end in zip(cuts, cuts[1:]):
        piece = _Piece(ts[begin:end], ok[begin:end], limit, ttl)
        attempted, after = piece.fold(state)
        mask = np.zeros(end - begin, bool)
        for first, last, _ in attempted:
            mask[first:last] = True
        got += mask.tolist()
        summaries.append(summarise_piece(piece, most))
        entries.append(state)
        oks.append(int((mask & ok[begin:end]).sum()))
        assert row(leave(array(state), summaries[-1], ttl)) == after
        assert successes(state, summaries[-1], ttl) == min(oks[-1], most)
        state = after
    assert got == [want["a", i] != "open" for i in range(n)]
    # Summaries of neighbours, taken together, lead to the same states.
    while len(summaries) > 1:
        at = random.randrange(len(summaries) - 1)
        size = random.randint(2, 4)
        summaries[at : at + size] = [compose(summaries[at : at + size], ttl, most)]
        del entries[at + 1 : at + size]
        oks[at : at + size] = [sum(oks[at : at + size])]
        states = [*entries[1:], state]
        assert [row(leave(array(e), t, ttl)) for e, t in zip(entries, summaries)] == states
        assert [successes(e, t, ttl) for e, t in zip(entries, summaries)] == [min(n, most) for n in oks]


def successes(state, summary, ttl):
    return leave(np.append(array(state), [[0]], axis=1), summary, ttl)[0, 3]


def array(state):
    return np.array([[state.open_until, state.fails, state.last_fail]])


def row(states):
    return BreakerState(*states[0].tolist())


@pytest.mark.parametrize(("seed", "services", "p_ok"), [(1, ("a",), 0.5), (2, ("a", "b", "c"), 0.3), (3, ("a",), 0.9)])
def test_breaker(spark, seed, services, p_ok):
    calls = history(seed, 3000, services, p_ok=p_ok)
    folded, states = limits.apply_breaker(table(spark, calls))
    want = simulate(calls)
    assert {(r.service, r.id): r.attempted for r in folded.collect()} == {k: v != "open" for k, v in want.items()}
    assert {r.service for r in states.collect()} == set(services)
    # The same through a tree of summaries.
    runs = ordered_runs(table(spark, calls), ["service"], ["ts", "id"], "calls")
    deep, deep_states = limits.fold_breaker(runs, ["service"], fan=2, piece_rows=70)
    assert {(r.service, r.id): r.attempted for r in deep.collect()} == {k: v != "open" for k, v in want.items()}
    assert sorted(deep_states.collect()) == sorted(states.collect())


def test_breaker_opens_at_the_third_failure_and_closes_after_its_time(spark):
    times = [0, 1, 2, 3, 300_001, 300_002, 300_003, 300_004, 300_005]
    calls = [("a", i, t + 1_000_000, False) for i, t in enumerate(times)]
    folded, _ = limits.apply_breaker(table(spark, calls))
    got = rows(folded.select("attempted", "tripped"), F.col("id"))
    assert got == [(True, False), (True, False), (True, True), (False, False), (False, False),
                   (True, False), (True, False), (True, True), (False, False)]


def test_failures_further_apart_than_the_memory_do_not_add_up(spark):
    calls = [("a", i, 1 + i * 300_000, False) for i in range(5)]
    assert limits.apply_breaker(table(spark, calls))[0].where("NOT attempted OR tripped").count() == 0


@pytest.mark.parametrize("quota", [1, 7, 1500])
def test_quota(spark, quota):
    calls = history(5, 3000, ("a", "b"), step=(1, 200_000))
    got = {(r.service, r.id): r.in_quota for r in limits.apply_quota(table(spark, calls), quota).collect()}
    used, want = {}, {}
    for service, rid, ts, ok in sorted(calls, key=lambda c: (c[2], c[1])):
        key = service, ts // DAY
        want[service, rid] = used.get(key, 0) < quota
        used[key] = used.get(key, 0) + ok
    assert got == want


@pytest.mark.parametrize(("seed", "quota", "p_ok"), [(1, 20, 0.5), (2, 5, 0.2), (3, 60, 0.8), (4, 3, 0.35)])
def test_breaker_and_quota_together(spark, seed, quota, p_ok):
    calls = history(seed, 4000, ("a", "b"), step=(1, 150_000), p_ok=p_ok)
    limited, _, used = limits.apply_limits(table(spark, calls), quota)
    want = simulate(calls, quota)
    assert outcomes(limited) == want
    assert "quota" in want.values() and "open" in want.values()
    assert used.where(f"used > {quota}").count() == 0


def test_sixty_days_that_each_decide_the_next(spark, monkeypatch):
    """A day whose quota runs out starts the next one clean, else two failures are carried over."""
    folds = []
    folded = limits._folded
    monkeypatch.setattr(limits, "_folded", lambda *a: folds.append(1) or folded(*a))
    calls, start = [], 1_704_067_200_000
    for day in range(60):
        morning, night = start + day * DAY, start + (day + 1) * DAY
        calls += [("a", 0, morning + 1, False), ("a", 0, morning + 2, True), ("a", 0, morning + 3, True)]
        calls += [("a", 0, night - 400_000 - i, True) for i in range({0: 0, 30: 3}.get(day, 1))]
        calls += [("a", 0, night - 2, False), ("a", 0, night - 1, False)]
    calls = [(s, i, ts, ok) for i, (s, _, ts, ok) in enumerate(calls)]
    limited, _, _ = limits.apply_limits(table(spark, calls), 3, fan=3, piece_rows=5)
    want = simulate(calls, 3)
    assert outcomes(limited) == want
    assert {"open", "quota"} <= set(want.values())
    assert folds == [1]


def test_a_day_that_ends_full_starts_the_next_one_clean(spark):
    night = 1_704_153_600_000
    calls = [("a", 0, night - 5, False), ("a", 1, night - 4, False), ("a", 2, night - 3, True)]
    calls += [("a", 3, night - 2, False), ("a", 4, night - 1, False), ("a", 5, night, False), ("a", 6, night + 1, False)]
    limited, states, _ = limits.apply_limits(table(spark, calls), 1)
    assert outcomes(limited) == simulate(calls, 1)
    assert rows(states) == [("a", 0, 2, night + 1)]


def test_limits_continue_over_batches(spark):
    calls = history(7, 1500, ("a", "b"), step=(1, 150_000), p_ok=0.4)
    want = simulate(calls, 10)
    carry = used = None
    got = {}
    for begin in range(0, 1500, 500):
        part = table(spark, calls[begin : begin + 500])
        limited, carry, used = limits.apply_limits(part, 10, carry=carry, used=used)
        got |= outcomes(limited)
        carry = spark.createDataFrame(carry.collect(), carry.schema)
        used = spark.createDataFrame(used.collect(), used.schema)
    assert got == want


def test_no_calls(spark):
    limited, states, used = limits.apply_limits(table(spark, history(1, 1)).where("false"), 5)
    assert limited.count() == states.count() == used.count() == 0


def test_hot_second_is_cut_before_its_shuffle(spark):
    calls = [("a", i, 1_704_067_200_000 + i % 3, i % 2 == 0) for i in range(5000)]
    limited = limits.apply_quota(table(spark, calls), 1500)
    assert limited.where("ok AND in_quota").count() == 1500
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pieces_stay_small_and_unsorted(spark):
    """No task folds more than 250,000 rows at once, and it takes them as they come."""
    import numpy as np
    import pandas as pd

    runs = spark.range(0, 600_000, 1, 1).select(F.lit(0).alias("_part"), F.col("id").alias("_row"))
    sizes = [r["count"] for r in limits._pieces(runs, limits.PIECE_ROWS)[0].groupBy("_piece").count().collect()]
    assert max(sizes) <= 250_000 and sum(sizes) == 600_000
    rng = np.random.default_rng(1)
    mixed = pd.DataFrame({"_row": rng.permutation(50)})
    mixed["ts"], mixed["ok"] = mixed["_row"] * 10, mixed["_row"] % 3 == 0
    before = mixed.copy()
    order, piece = limits._piece_of(mixed, 3, 100)
    assert mixed.equals(before) and list(mixed["_row"].to_numpy()[order]) == list(range(50))
    assert list(piece.ts) == list(range(0, 500, 10)) and piece.oks[-1] == 17
