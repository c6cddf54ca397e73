"""Daily quota and failure breaker over a history of scoring calls.

Calls are ``(service, id, ts, ok)``, ``ts`` in epoch ms, folded in the order of (ts, id).
``ok`` says how the call would end if it is attempted. A quota or a breaker is sequential
by nature, and one service may own every row, so neither is a window or a grouped fold
over the service:

* quota: counts per second find the second in which the quota runs out, and only the rows
  of that second are ranked;
* breaker: pieces of bounded size summarise themselves as functions from the state they are
  entered with to the state they are left with. Composing these functions up and down a tree
  (a prefix scan) gives each piece its true entry state, and all pieces then fold their rows
  in parallel;
* both: a summary also counts successes, so that the summary of a day that may use up its
  quota says whether it does, and such days compose like pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY_MS, SECOND_MS
from ..session import stage
from .ranking import ROW_BITS, broadcast_if_few, ordered_runs

# Scored calls per UTC day; failures that open the breaker; both its times.
DAILY_QUOTA = 500
FAILURE_LIMIT = 3
BREAKER_MS = 300_000

CALLS = ["service", "id", "ts", "ok"]


# --- quota -----------------------------------------------------------------------------


def quota_cutoffs(
    successes: DataFrame, quota: int = DAILY_QUOTA, used: DataFrame | None = None
) -> DataFrame:
    """``(service, day, cut_ts, cut_id)``: the success that uses up each day's quota.

    ``successes(service, day, ts, id)``; ``used(service, day, used)`` counts successes of
    earlier batches. The running sum goes over at most 86,400 rows a day; a day whose quota
    was used up before has a cut in front of all its rows.
    """
    second = F.floor(F.col("ts") / SECOND_MS)
    day = ["service", "day"]
    seconds = successes.groupBy(*day, second.alias("_second")).agg(F.count(F.lit(1)).alias("_n"))
    if used is None:
        seconds = seconds.withColumn("used", F.lit(0))
        spent = None
    else:
        seconds = seconds.join(used.select(*day, "used"), day, "left").fillna(0, "used")
        spent = used.where(F.col("used") >= quota)
    by_day = Window.partitionBy(*day).orderBy("_second")
    total = F.col("used") + F.sum("_n").over(by_day)
    edge = (
        seconds.withColumn("_total", total)
        .withColumn("_left", F.lit(quota) - (F.col("_total") - F.col("_n")))
        .where((F.col("_left") > 0) & (F.col("_total") >= quota))
        .select(*day, "_second", "_left")
    )
    within = Window.partitionBy(*day, "_second").orderBy("ts", "id")
    cuts = (
        successes.withColumn("_second", second)
        .join(edge, [*day, "_second"])
        .withColumn("_rank", F.row_number().over(within))
        .where((F.col("_rank") <= quota) & (F.col("_rank") == F.col("_left")))
        .select(*day, F.col("ts").alias("cut_ts"), F.col("id").alias("cut_id"))
    )
    if spent is not None:
        cuts = cuts.unionByName(
            spent.select(
                *day,
                F.lit(-1).cast("bigint").alias("cut_ts"),
                F.lit(None).cast(successes.schema["id"].dataType).alias("cut_id"),
            )
        )
    return cuts


def utc_day(ts="ts"):
    return F.floor(F.col(ts) / DAY_MS).cast("bigint")


def _within_quota(calls: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``in_quota``: no later than the success that used up the day's quota."""
    after = (F.col("ts") > F.col("cut_ts")) | (
        (F.col("ts") == F.col("cut_ts")) & (F.col("id") > F.col("cut_id"))
    )
    return (
        calls.join(cuts, ["service", "day"], "left")
        .withColumn("in_quota", ~F.coalesce(after, F.lit(False)))
        .drop("cut_ts", "cut_id")
    )


def apply_quota(
    calls: DataFrame, quota: int = DAILY_QUOTA, used: DataFrame | None = None
) -> DataFrame:
    """Add ``day`` and ``in_quota``; only successes count against the quota."""
    dated = calls.withColumn("day", utc_day())
    cuts = quota_cutoffs(dated.where("ok").select("service", "day", "ts", "id"), quota, used)
    return _within_quota(dated, cuts)


# --- breaker ---------------------------------------------------------------------------


@dataclass(frozen=True)
class BreakerState:
    """Open until ``open_until`` (0: closed), or ``fails`` failures, the last at ``last_fail``."""

    open_until: int = 0
    fails: int = 0
    last_fail: int = 0


STATE_COLUMNS = ["open_until", "fails", "last_fail"]
_STATE_DDL = "open_until bigint, fails bigint, last_fail bigint"
# A summary's outcome: the state after it, and the successes on the way.
OUTCOME = [*STATE_COLUMNS, "n_ok"]


class _Piece:
    """The rows of one service in one range partition, in order.

    A failure counts on from the one before if that is less than ``ttl`` ago; ``limit``
    failures without a success between them open the breaker for ``ttl``. A breaker that
    is clean at some row therefore trips at the first row that ends a run of ``limit``
    failures begun at or after it, so each start leads to one trip and each trip to one
    next start.
    """

    def __init__(self, ts: np.ndarray, ok: np.ndarray, limit: int, ttl: int):
        self.ts, self.limit, self.ttl = ts, limit, ttl
        row = np.arange(len(ts))
        begins = ok | (np.diff(ts, prepend=ts[:1]) >= ttl) | (row == 0)
        begin = np.maximum.accumulate(np.where(begins, row, 0))
        self.run = np.where(ok, 0, row - begin + ~ok[begin])
        self.trips = np.flatnonzero(self.run >= limit)
        self.oks = np.append(0, np.cumsum(ok))

    def carried(self, state: BreakerState) -> int:
        return state.fails if self.ts[0] - state.last_fail < self.ttl else 0

    def next_trip(self, start):
        """Number of the first trip of a breaker that is clean at row ``start``."""
        return np.searchsorted(self.trips, start + self.limit - 1)

    def closed_end(self, start: int, carried: int = 0) -> BreakerState:
        """State at the end for a breaker that is clean at ``start`` and trips no more."""
        rows = len(self.ts)
        fails = min(int(self.run[-1]), rows - start)
        if start == 0 and fails == rows:
            fails += carried
        return BreakerState(0, fails, int(self.ts[-1])) if fails else BreakerState()

    def fold(self, state: BreakerState) -> tuple[list[tuple[int, int, bool]], BreakerState]:
        """Attempted intervals ``(first row, end, ended by a trip)`` and the state after.

        One step per trip, and trips are at least ``ttl`` apart.
        """
        attempted, start, rows = [], 0, len(self.ts)
        if state.open_until:
            if state.open_until > self.ts[-1]:
                return attempted, state
            start, state = int(np.searchsorted(self.ts, state.open_until)), BreakerState()
        carried = self.carried(state)
        early = self.limit - carried - 1
        if carried and early < rows and self.run[early] == early + 1:
            trip = early
        else:
            trip = self._trip_row(start)
        while trip is not None:
            attempted.append((start, trip + 1, True))
            until = int(self.ts[trip]) + self.ttl
            start = int(np.searchsorted(self.ts, until))
            if start == rows:
                return attempted, BreakerState(open_until=until)
            trip = self._trip_row(start)
        attempted.append((start, rows, False))
        return attempted, self.closed_end(start, carried)

    def after(self, state: BreakerState) -> tuple[BreakerState, int]:
        """State after the piece and how many calls succeed in it."""
        attempted, end = self.fold(state)
        return end, sum(int(self.oks[last] - self.oks[first]) for first, last, _ in attempted)

    def _trip_row(self, start: int) -> int | None:
        number = int(self.next_trip(start))
        return int(self.trips[number]) if number < len(self.trips) else None

    def exits_if_open(self, most: int) -> list[tuple[int, BreakerState, int]]:
        """Outcome of the piece by the time at which a breaker open on entry closes.

        A step function ``(from, state, successes up to most)``. That time is at most ``ttl``
        after the first row; all trips' final states, and the successes on the way there, come
        from following the trip pointers by doubling.
        """
        rows, trips = len(self.ts), self.trips
        resumed = np.searchsorted(self.ts, self.ts[trips] + self.ttl)
        upto = np.append(trips + 1, rows)  # where attempts end before trip number i, or at the end
        following = self.next_trip(resumed)
        gained = self.oks[upto[following]] - self.oks[resumed]
        final = np.where((resumed < rows) & (following < len(trips)), following, np.arange(len(trips)))
        gained_to = np.where(final == np.arange(len(trips)), 0, gained)
        last_gain = gained
        while (final[final] != final).any():
            gained_to = gained_to + gained_to[final]
            final = final[final]

        starts = np.flatnonzero(np.diff(self.ts, prepend=self.ts[0] - 1) > 0)
        starts = starts[: np.searchsorted(self.ts[starts], self.ts[0] + self.ttl) + 1]
        steps: list[tuple[int, BreakerState, int]] = []
        since = 0
        for start, number in zip(starts.tolist(), self.next_trip(starts).tolist(), strict=True):
            n_ok = int(self.oks[upto[number]] - self.oks[start])
            if number == len(trips):
                state = self.closed_end(start)
            else:
                last = final[number]
                n_ok += int(gained_to[number] + last_gain[last])
                if resumed[last] == rows:
                    state = BreakerState(open_until=int(self.ts[trips[last]]) + self.ttl)
                else:
                    state = self.closed_end(int(resumed[last]))
            n_ok = min(n_ok, most)
            if not steps or steps[-1][1:] != (state, n_ok):
                steps.append((since, state, n_ok))
            since = int(self.ts[start]) + 1
        return steps


def _table(entries: list[tuple[int, int, BreakerState, int]], first: int, last: int) -> pd.DataFrame:
    """A summary as rows: ``carried`` failures on entry, or (-1) open, closing from ``since``."""
    return pd.DataFrame(
        [(c, t, s.open_until, s.fails, s.last_fail, n, first, last) for c, t, s, n in entries],
        columns=["carried", "since", *OUTCOME, "first_ts", "last_ts"],
    )


def summarise_piece(piece: _Piece, most: int = 0) -> pd.DataFrame:
    """Counts stop at ``most`` successes: beyond a quota they make no difference."""
    first, last = int(piece.ts[0]), int(piece.ts[-1])
    closed = []
    for c in range(piece.limit):
        state, n_ok = piece.after(BreakerState(0, c, first))
        closed.append((c, -1, state, min(n_ok, most)))
    opened = [(-1, since, state, n_ok) for since, state, n_ok in piece.exits_if_open(most)]
    return _table(closed + opened, first, last)


def _split(table: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, int, int]:
    """States by carried failures, steps by closing time, first and last time."""
    closed = table[table["carried"] >= 0].sort_values("carried")
    steps = table[table["carried"] < 0].sort_values("since", ignore_index=True)
    return closed, steps, int(table["first_ts"].iloc[0]), int(table["last_ts"].iloc[0])


def leave(states: np.ndarray, table: pd.DataFrame, ttl: int) -> np.ndarray:
    """States (one per row, with or without ``n_ok``) after what ``table`` summarises."""
    closed, steps, first, last = _split(table)
    columns = OUTCOME[: states.shape[1]]
    until, fails, last_fail = states[:, :3].T
    out = states.copy()
    shut = until == 0
    carried = np.where(first - last_fail < ttl, fails, 0)[shut]
    out[shut] = closed[columns].to_numpy()[carried]
    inside = ~shut & (until <= last)
    at = np.searchsorted(steps["since"].to_numpy(), until[inside], side="right") - 1
    out[inside] = steps[columns].to_numpy()[at]
    passed = shut | inside
    out[passed, 3:] += states[passed, 3:]
    return out


def compose(tables: list[pd.DataFrame], ttl: int, most: int = 0) -> pd.DataFrame:
    """The summary of consecutive pieces taken together."""
    first = int(tables[0]["first_ts"].iloc[0])
    last = int(tables[-1]["last_ts"].iloc[0])
    closed = _split(tables[0])[0]
    kinds = [closed["carried"].to_numpy()]
    since = [closed["since"].to_numpy()]
    states = closed[OUTCOME].to_numpy()
    for table in tables[1:]:
        states = leave(states, table, ttl)
    found = [states]
    after = 0
    for i, table in enumerate(tables):
        # A breaker that closes after the pieces before comes to this one unchanged.
        _, steps, _, end = _split(table)
        begin = steps["since"].to_numpy()
        keep = np.append(begin[1:], end + 1) > after
        begin = np.maximum(begin, after)
        keep &= begin <= first + ttl
        states = steps[OUTCOME].to_numpy()[keep]
        for later in tables[i + 1 :]:
            states = leave(states, later, ttl)
        kinds.append(np.full(len(states), -1))
        since.append(begin[keep])
        found.append(states)
        after = end + 1
    kind, start, state = np.concatenate(kinds), np.concatenate(since), np.vstack(found)
    state[:, 3] = np.minimum(state[:, 3], most)
    same = (kind[1:] == -1) & (kind[:-1] == -1) & (state[1:] == state[:-1]).all(axis=1)
    keep = np.append(True, ~same)
    out = pd.DataFrame(state[keep], columns=OUTCOME)
    return out.assign(carried=kind[keep], since=start[keep], first_ts=first, last_ts=last)


_TABLE_DDL = f"carried int, since bigint, {_STATE_DDL}, n_ok bigint, first_ts bigint, last_ts bigint"
_BEGIN = [f"begin_{c}" for c in STATE_COLUMNS]
_END = [f"end_{c}" for c in STATE_COLUMNS]
# Rows of one piece, which is folded in memory: some 30 MB of a Python worker, however long the history.
PIECE_ROWS = 250_000
# Pieces whose summaries one task takes together: a summary has at most one step per
# millisecond of the open time, however many rows it stands for.
FAN = 16


def fold_breaker(
    runs: DataFrame,
    keys: list[str],
    limit: int = FAILURE_LIMIT,
    ttl_ms: int = BREAKER_MS,
    carry: DataFrame | None = None,
    fan: int = FAN,
    piece_rows: int = PIECE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Fold calls from ``ordered_runs``; returns them with ``attempted, tripped`` and the
    states ``(*keys, open_until, fails, last_fail)`` at the end.

    ``carry`` gives states to begin with, in the same columns. Summaries are composed up a
    tree of ``fan`` children per node; entry states then come down the same tree, so that
    no task ever sees more than ``fan`` summaries of a service, or ``piece_rows`` rows.
    """
    pieces, n_pieces = _pieces(runs, piece_rows)
    tree = _tree(_summaries(pieces, keys, limit, ttl_ms, 0), keys, n_pieces, ttl_ms, 0, fan)
    entries, states = _entries(tree, keys, ttl_ms, carry, fan)
    return _folded(pieces, entries, keys, limit, ttl_ms), states


def _pieces(runs: DataFrame, piece_rows: int) -> tuple[DataFrame, int]:
    """Rows with ``_piece``, which numbers blocks of range partitions in order; how many numbers."""
    row = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    last_part, last_row = runs.agg(F.max("_part"), F.max(row)).first()
    blocks = (last_row or 0) // piece_rows + 1
    block = F.floor(row / F.lit(piece_rows)).cast("bigint")
    return runs.withColumn("_piece", F.col("_part") * F.lit(blocks) + block), ((last_part or 0) + 1) * blocks


def _key_ddl(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)


def _piece_of(rows: pd.DataFrame, limit: int, ttl_ms: int) -> tuple[np.ndarray, _Piece]:
    """Where the piece's rows stand in ``rows``, which stay as they are, and the piece."""
    order = np.argsort(rows["_row"].to_numpy(), kind="stable")
    return order, _Piece(rows["ts"].to_numpy()[order], rows["ok"].to_numpy(bool)[order], limit, ttl_ms)


def _in_order(rows: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    return [(node, table) for node, table in rows.groupby("node", sort=True)]


def _summaries(pieces: DataFrame, keys: list[str], limit: int, ttl_ms: int, most: int) -> DataFrame:
    """One summary per key and piece, as rows with ``node``."""

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return summarise_piece(_piece_of(rows, limit, ttl_ms)[1], most).assign(
            **{c: first[c] for c in keys}, node=first["_piece"]
        )

    narrow = pieces.select(*keys, "_piece", "_row", "ts", "ok")
    ddl = f"{_key_ddl(pieces, keys)}, node bigint, {_TABLE_DDL}"
    return narrow.groupBy(*keys, "_piece").applyInPandas(summarise, ddl)


def _merged(level: DataFrame, keys: list[str], fan: int, ttl_ms: int, most: int) -> DataFrame:
    """Summaries of ``fan`` neighbours each taken together."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return compose([table for _, table in _in_order(rows)], ttl_ms, most).assign(
            **{c: first[c] for c in keys}, node=first["parent"]
        )

    ddl = f"{_key_ddl(level, keys)}, node bigint, {_TABLE_DDL}"
    return _with_parent(level, fan).groupBy(*keys, "parent").applyInPandas(merge, ddl)


def _with_parent(level: DataFrame, fan: int) -> DataFrame:
    return level.withColumn("parent", F.expr(f"node div {fan}"))


def _tree(
    summaries: DataFrame, keys: list[str], nodes: int, ttl_ms: int, most: int, fan: int
) -> list[DataFrame]:
    """Levels from the given summaries, numbered below ``nodes``, to one of at most ``fan``."""
    levels = [stage(summaries, "breaker-summaries")]
    while nodes > fan:
        levels.append(stage(_merged(levels[-1], keys, fan, ttl_ms, most), "breaker-summaries"))
        nodes = -(-nodes // fan)
    return levels


def _entries(
    levels: list[DataFrame], keys: list[str], ttl_ms: int, carry: DataFrame | None, fan: int
) -> tuple[DataFrame, DataFrame]:
    """The state each node of the lowest level is entered with, and the state after the last."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        state = first[_BEGIN].to_numpy().astype("int64").reshape(1, -1)
        out = []
        for node, table in _in_order(rows):
            entry, state = state, leave(state, table, ttl_ms)
            out.append((node, *entry[0], *state[0]))
        return pd.DataFrame(out, columns=["node", *_BEGIN, *_END]).assign(
            **{c: first[c] for c in keys}
        )

    states_ddl = ", ".join(f"{c} bigint" for c in [*_BEGIN, *_END])
    ddl = f"{_key_ddl(levels[0], keys)}, node bigint, {states_ddl}"
    if carry is None:
        top = levels[-1].withColumns({c: F.lit(0).cast("bigint") for c in _BEGIN})
    else:
        begin = carry.select(*keys, *[F.col(c).alias(b) for c, b in zip(STATE_COLUMNS, _BEGIN)])
        top = levels[-1].join(begin, keys, "left").fillna(0, _BEGIN)
    entries = stage(top.groupBy(*keys).applyInPandas(walk, ddl), "breaker-entries")
    ends = F.struct("node", *[F.col(e).alias(c) for e, c in zip(_END, STATE_COLUMNS)])
    states = (
        entries.groupBy(*keys)
        .agg(F.max(ends).alias("_end"))
        .select(*keys, *[F.col("_end")[c].alias(c) for c in STATE_COLUMNS])
    )
    for level in reversed(levels[:-1]):
        above = entries.select(*keys, F.col("node").alias("parent"), *_BEGIN)
        children = _with_parent(level, fan).join(above, [*keys, "parent"])
        below = children.groupBy(*keys, "parent").applyInPandas(walk, ddl)
        entries = stage(below, "breaker-entries")
    return entries, states


def _folded(
    pieces: DataFrame, entries: DataFrame, keys: list[str], limit: int, ttl_ms: int
) -> DataFrame:
    """All rows with ``attempted, tripped``, every piece folded from its entry state."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        order, p = _piece_of(rows, limit, ttl_ms)
        attempted, tripped = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        entry = BreakerState(*(int(rows[c].iloc[0]) for c in _BEGIN))
        for first, end, trip in p.fold(entry)[0]:
            attempted[order[first:end]] = True
            tripped[order[end - 1]] |= trip
        return rows.drop(columns=_BEGIN).assign(attempted=attempted, tripped=tripped)

    row_ddl = _key_ddl(pieces, pieces.columns)
    entered = entries.select(*keys, F.col("node").alias("_piece"), *_BEGIN)
    return (
        pieces.join(entered, [*keys, "_piece"])
        .select(*pieces.columns, *_BEGIN)
        .groupBy(*keys, "_piece")
        .applyInPandas(fold, f"{row_ddl}, attempted boolean, tripped boolean")
        .drop("_piece")
    )


def apply_breaker(
    calls: DataFrame,
    limit: int = FAILURE_LIMIT,
    ttl_ms: int = BREAKER_MS,
    carry: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Calls with ``attempted, tripped``, and the breaker states after the last call."""
    runs = ordered_runs(calls.select(*CALLS), ["service"], ["ts", "id"], "calls")
    folded, states = fold_breaker(runs, ["service"], limit, ttl_ms, carry)
    return folded.drop("_part", "_row"), states


# --- both ------------------------------------------------------------------------------


def apply_limits(
    calls: DataFrame,
    quota: int = DAILY_QUOTA,
    limit: int = FAILURE_LIMIT,
    ttl_ms: int = BREAKER_MS,
    carry: DataFrame | None = None,
    used: DataFrame | None = None,
    fan: int = FAN,
    piece_rows: int = PIECE_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breaker first, then quota, then the attempt.

    Returns calls with ``outcome`` (``open``, ``quota``, ``ok`` or ``failed``), the breaker
    states, and ``(service, day, used)``.

    The two meet only at day ends: a day's quota always runs out at a success, which
    leaves the breaker clean, and the rest of that day is not attempted. So the rest of a
    used-up day is denied by the quota alone, and the day after it starts clean. Days with
    enough successes at all are segments of their own, all days between two of them are one.
    A segment's summary says for each state it may be entered with how it is left and how many
    calls succeed; where these use up the day's quota it is left clean instead. Segments then
    compose like pieces, which gives each its entry state: two passes over the rows, however
    many days decide the next.

    Calls that what is handed on denies, late ones of a used-up day among them, leave the breaker
    as it is and do not take part in this.
    """
    dated = calls.select(*CALLS).withColumn("day", utc_day())
    denied = None
    if used is not None:
        dated, denied = _denied_before(dated, quota, carry, used)
    runs = ordered_runs(dated, ["service"], ["ts", "id"], "calls")
    segments = broadcast_if_few(_segments(runs, quota, used), "quota-days")
    runs = runs.join(segments, ["service", "day"]).select(*runs.columns, "segment")
    pieces, n_pieces = _pieces(runs, piece_rows)
    n_segments = (segments.agg(F.max("segment")).first()[0] or 0) + 1

    keys = ["service", "segment"]
    summaries = _summaries(pieces, keys, limit, ttl_ms, quota)
    tree = _tree(summaries, keys, n_pieces, ttl_ms, quota, fan)
    whole = _merged(tree[-1], keys, n_pieces, ttl_ms, quota).drop("node")
    settled = _clean_if_full(whole, segments, quota).withColumnRenamed("segment", "node")
    above, states = _entries(
        _tree(settled, ["service"], n_segments, ttl_ms, 0, fan), ["service"], ttl_ms, carry, fan
    )
    begin = above.select(
        "service",
        F.col("node").alias("segment"),
        *[F.col(b).alias(c) for b, c in zip(_BEGIN, STATE_COLUMNS)],
    )
    entries, _ = _entries(tree, keys, ttl_ms, begin, fan)
    folded = _folded(pieces, entries, keys, limit, ttl_ms).drop("_part", "_row", "segment")
    folded = stage(folded, "breaker-calls")
    good = folded.where(F.col("attempted") & F.col("ok")).select("service", "day", "ts", "id")
    cuts = stage(quota_cutoffs(good, quota, used), "quota-cuts")
    out = _within_quota(folded, cuts).withColumn(
        "outcome",
        F.when(~F.col("in_quota"), "quota")
        .when(~F.col("attempted"), "open")
        .when(F.col("ok"), "ok")
        .otherwise("failed"),
    )
    out = out.drop("attempted", "in_quota", "tripped")
    if denied is not None:
        out = out.unionByName(_denials(denied, folded, ttl_ms).select(*out.columns))
        if carry is not None:
            states = states.unionByName(carry.join(states, "service", "left_anti").select(*states.columns))
    return out, states, _used(out, used)


def _denied_before(
    dated: DataFrame, quota: int, carry: DataFrame | None, used: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Calls to be settled; and those that the breaker (``_shut``) or the day's use denies already."""
    spent = used.where(F.col("used") >= quota).select("service", "day", F.lit(True).alias("_spent"))
    told = dated.join(spent, ["service", "day"], "left").fillna(False, "_spent")
    if carry is None:
        told = told.withColumn("_shut", F.lit(False))
    else:
        told = told.join(carry.select("service", F.col("open_until").alias("_until")), "service", "left")
        told = told.withColumn("_shut", F.col("ts") < F.coalesce("_until", F.lit(0)))
    gone = F.col("_shut") | F.col("_spent")
    return told.where(~gone).select(*dated.columns), told.where(gone).select(*dated.columns, "_shut")


def _denials(denied: DataFrame, folded: DataFrame, ttl_ms: int) -> DataFrame:
    """``outcome`` of calls denied before; a trip on an earlier day may reach into a used-up one."""
    trips = folded.where("tripped").groupBy("service", "day").agg(F.max("ts").alias("_trip"))
    days = denied.select("service", "day").distinct().withColumn("_trip", F.lit(None).cast("bigint"))
    earlier_days = Window.partitionBy("service").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    last = (
        days.unionByName(trips)
        .groupBy("service", "day")
        .agg(F.max("_trip").alias("_trip"))
        .select("service", "day", (F.max("_trip").over(earlier_days) + ttl_ms).alias("_closes"))
    )
    still_open = F.col("_shut") | (F.col("ts") < F.coalesce("_closes", F.lit(0)))
    return denied.join(last, ["service", "day"], "left").withColumn(
        "outcome", F.when(still_open, "open").otherwise("quota")
    )


def _segments(runs: DataFrame, quota: int, used: DataFrame | None) -> DataFrame:
    """``(service, day, before, segment)``: odd segments are days that may use up their quota."""
    days = runs.groupBy("service", "day").agg(F.count_if("ok").alias("_n"))
    if used is None:
        days = days.withColumn("before", F.lit(0).cast("bigint"))
    else:
        earlier = used.select("service", "day", F.col("used").alias("before"))
        days = days.join(earlier, ["service", "day"], "left").fillna(0, "before")
    may = (F.col("_n") + F.col("before") >= F.lit(quota)).cast("bigint")
    earlier_days = Window.partitionBy("service").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("_may").over(earlier_days), F.lit(0))
    return days.withColumn("_may", may).select(
        "service", "day", "before", (2 * passed + F.col("_may")).alias("segment")
    )


def _clean_if_full(whole: DataFrame, segments: DataFrame, quota: int) -> DataFrame:
    """Summaries of segments, left clean on the ways on which a day's quota runs out."""
    single = segments.where("segment % 2 = 1").select("service", "segment", "before")
    full = F.coalesce(F.col("n_ok") + F.col("before") >= F.lit(quota), F.lit(False))
    clean = {c: F.when(full, F.lit(0)).otherwise(F.col(c)) for c in STATE_COLUMNS}
    known = whole.join(single, ["service", "segment"], "left")
    return known.withColumns(clean).withColumn("n_ok", F.lit(0).cast("bigint")).drop("before")


def _used(out: DataFrame, used: DataFrame | None) -> DataFrame:
    now = out.groupBy("service", "day").agg(F.count_if(F.col("outcome") == "ok").alias("used"))
    if used is None:
        return now
    return (
        now.unionByName(used.select("service", "day", "used"))
        .groupBy("service", "day")
        .agg(F.sum("used").alias("used"))
    )
