"""Substring dedup: documents are factored against an index of reference blocks.

The reference is the collection itself, hash-partitioned into blocks of phrases. A phrase is a run of
words around an anchor: in every window of ``width`` words the run of ``anchor`` words with the least
hash is its anchor, so two equal windows have equal anchors wherever they stand. All windows of one
anchor in a place form a phrase.

1. Each phrase goes, once a task, to the block of its anchor, where the least document that has the
   phrase is looked up, and the place where it stands there. Phrases that occur in one document under
   an anchor of their own end here.
2. Windows at factor boundaries, those whose anchor is known with other phrases, are decided one by
   one: their hashes go through blocks again, and only for documents that have such windows.
3. Each document is parsed greedily against what the blocks returned: a factor starts at the first
   window known from a smaller document and grows while the next window is the next one of that
   document, so a factor is a run of words that its document holds as it is. Where it ends, the next
   window is looked at anew, so factors may overlap by up to ``width - 1`` words. What the factors
   cover, each of at least ``width`` words, goes; nothing else does.

The result is exact but for 64-bit hash collisions: a window goes if and only if its words also stand,
in this order, in a document with a smaller id. A phrase that a third of all documents hold is one
entry a task in the first shuffle, with the ids it stands for.

Defined cases: null and empty texts have no words; a document with fewer than ``width`` words loses
none; repeats inside a document, and in rows that share its id, stay; a null id is smaller than any
other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, stage
from .common import by_slice, by_task, id_and_text

WIDTH, ANCHOR = 13, 5
NO_ID = -(1 << 63)  # stands for a null id
NONE = (1 << 63) - 1  # no document has the window

# Rows of one task are combined in runs of this many phrases before they are shuffled.
COMBINE = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64))


class Words:
    """Words of a text with polynomial hashes of any run of them (modulo 2**64, then mixed)."""

    def __init__(self, text: str):
        self.words = text.encode().split()  # the ASCII white space that bytes.split knows
        n = len(self.words)
        data = np.frombuffer(b" ".join(self.words) + b" ", dtype=np.uint8) if n else np.zeros(0, np.uint8)
        self.stops = np.cumsum(np.fromiter(map(len, self.words), np.int64, n) + 1)
        self.starts = np.concatenate([[0], self.stops[:-1]]) if n else self.stops
        terms = _BYTE_VALUES[data] * _powers(_ODD, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.at_start = sums[self.starts]
        self.at_stop = sums[self.stops]
        self.shift = _powers(_INVERSE, len(data) + 1)[self.starts]

    def __len__(self) -> int:
        return len(self.words)

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs from word ``first`` to word ``last``, both included."""
        return _mixed((self.at_stop[last] - self.at_start[first]) * self.shift[first])

    def windows(self, width: int) -> np.ndarray:
        first = np.arange(max(0, len(self) - width + 1))
        return self.runs(first, first + width - 1)

    def phrases(self, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per phrase: hash of its anchor, hash of all its words, first and last window."""
        n = len(self) - width + 1
        if n < 1:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        grams = self.windows(anchor)
        inside = width - anchor + 1
        view = np.lib.stride_tricks.sliding_window_view(grams, inside)
        place = view.argmin(axis=1) + np.arange(n)  # the leftmost least: the same in equal windows
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        return grams[place[first]], self.runs(first, last + width - 1), first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _combined(columns: list[np.ndarray]) -> dict[str, object]:
    """Rows (hashes..., id, place) combined by the hashes: least id, its first place, other ids as bytes.

    Places of a document come in ascending order, and the sort is stable.
    """
    *keys, ids, places = columns
    order = np.lexsort([ids, *keys[::-1]])
    keys, ids, places = [k[order] for k in keys], ids[order], places[order]
    fresh = np.zeros(len(ids), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    repeat = ~fresh
    repeat[1:] &= ids[1:] == ids[:-1]  # the same document again
    keys, ids, places, fresh = [k[~repeat] for k in keys], ids[~repeat], places[~repeat], fresh[~repeat]
    first = np.flatnonzero(fresh)
    stop = np.append(first[1:], len(ids))
    raw, many = ids.tobytes(), stop - first > 1
    others: list[bytes | None] = [None] * len(first)
    for i in np.flatnonzero(many).tolist():
        others[i] = raw[8 * (first[i] + 1) : 8 * stop[i]]
    return {"keys": [k[first] for k in keys], "id": ids[first], "place": places[first], "others": others}


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return np.array([NO_ID if v is None else v for v in part.column("doc_id").to_pylist()], dtype=np.int64)


def phrase_entries(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """(anchor, phrase, least, place, others) of the phrases of each task, combined."""

    def run(parts):
        held: list[list[np.ndarray]] = []
        size = 0
        for part in parts:
            for doc_id, text in zip(_ids(part).tolist(), part.column("text").to_pylist(), strict=True):
                anchors, phrases, first, _ = Words(text).phrases(width, anchor)
                held.append([anchors, phrases, np.full(len(anchors), doc_id), first])
                size += len(anchors)
            if size >= COMBINE:
                yield flushed(held)
                held, size = [], 0
        if held:
            yield flushed(held)

    def flushed(held):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        out = _combined([_signed(columns[0]), _signed(columns[1]), *columns[2:]])
        anchors, phrases = out["keys"]
        return {"anchor": anchors, "phrase": phrases, "least": out["id"], "place": out["place"], "others": out["others"]}

    return by_task(docs, run, "anchor long, phrase long, least long, place long, others binary")


def _spread(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per document of a combined entry."""
    schema = rows.select(*keep).schema.add("doc_id", "long")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def run(part: pa.RecordBatch):
        lists = [
            np.frombuffer(o, dtype=np.int64) if o else np.zeros(0, np.int64)
            for o in part.column("others").to_pylist()
        ]
        each = np.array([1 + len(o) for o in lists], dtype=np.int64)
        index = pa.array(np.repeat(np.arange(len(lists)), each))
        least = part.column("least").to_pylist()
        ids = np.concatenate([x for a, b in zip(least, lists, strict=True) for x in ([a], b)]) if lists else each
        return {k: part.column(k).take(index) for k in keep} | {"doc_id": ids.astype(np.int64)}

    return by_slice(rows, run, ddl)


def _known(entries: DataFrame) -> DataFrame:
    """Step 1: per (doc_id): what the blocks know of its phrases.

    ``first`` is the least document of a phrase and ``at`` the phrase's first window there; ``mixed``
    tells that its anchor has other phrases.
    Both windows use one shuffle, by anchor. Entries of a phrase are at most one a task.
    """
    phrase = Window.partitionBy("anchor", "phrase")
    anchor = Window.partitionBy("anchor")
    several = (F.min("least").over(anchor) != F.max("least").over(anchor)) | (
        F.count("others").over(anchor) > 0
    )
    judged = (
        entries.withColumns(
            {"several": several, "mixed": F.min("phrase").over(anchor) != F.max("phrase").over(anchor)}
        )
        .where("several")  # an anchor of one document alone, however often, says nothing
        .withColumn("_first", F.min(F.struct("least", "place")).over(phrase))
        .withColumns({"first": F.col("_first.least"), "at": F.col("_first.place")})
    )
    useful = judged.where("mixed OR others IS NOT NULL OR least <> first")
    spread = _spread(useful, "anchor", "phrase", "first", "at", "mixed")
    # A document that is itself the first needs to know only of mixed anchors.
    return spread.where("mixed OR doc_id <> first")


def _covered(found: list[tuple[int, int, int, int]], n_words: int) -> np.ndarray:
    """Whether each word lies under a factor."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    if found:
        start, words = np.array([f[:2] for f in found], dtype=np.int64).T
        np.add.at(change, start, 1)
        np.add.at(change, start + words, -1)
    return np.cumsum(change[:-1]) > 0


def factors(reference: np.ndarray, place: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (first word, words, document, its word) of the factors of at least ``width`` words.

    Window i stands in document ``reference[i]`` (or NONE) from word ``place[i]`` on. A factor grows
    while the next window is the next one of the same document.
    """
    if not len(reference):
        return []
    goes_on = (reference[1:] == reference[:-1]) & ((place[1:] == place[:-1] + 1) | (reference[1:] == NONE))
    cut = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    stop = np.append(cut[1:], len(reference))
    hit = reference[cut] != NONE
    cut, stop = cut[hit], stop[hit]
    columns = cut, stop - cut + width - 1, reference[cut], place[cut]
    return list(zip(*[c.tolist() for c in columns], strict=True))


def _lookup(table: np.ndarray, values: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """``values`` of ``keys`` where ``table`` has them, else NONE; the table need not be sorted."""
    if not len(table):
        return [np.full(len(keys), NONE, dtype=np.int64) for _ in values]
    order = np.argsort(table, kind="stable")
    place = order[np.minimum(np.searchsorted(table[order], keys), len(table) - 1)]
    found = table[place] == keys
    return [np.where(found, v[place], NONE) for v in values]


def _longs(values: list | None) -> np.ndarray:
    return np.array(values or [], dtype=np.int64)


_RESULT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start: long, words: long, doc_id: long, at: long>>"


def _settled(text: str, reference: np.ndarray, place: np.ndarray, width: int, shape) -> dict[str, object]:
    words = text.encode().split()
    found = factors(reference, place, width)
    kept = words
    if found:
        gone = _covered(found, len(words))
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return {
        "n_words": len(words),
        "n_removed": len(words) - len(kept),
        "kept": shape(b" ".join(kept).decode()),
        "factors": [
            {"start": a, "words": n, "doc_id": None if d == NO_ID else d, "at": at} for a, n, d, at in found
        ],
    }


def _per_doc(known: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row per document with the phrases, mixed anchors and windows that concern it."""
    phrase = F.when(F.col("first") != F.col("doc_id"), F.struct(F.col("phrase").alias("hash"), "first", "at"))
    rows = known.select(
        "doc_id", phrase.alias("copy"), F.when(F.col("mixed"), F.col("anchor")).alias("mixed"), _nothing().alias("window")
    )
    if found is not None:
        window = F.struct(F.col("window").alias("hash"), "first", "at")
        rows = rows.unionByName(
            found.select("doc_id", _nothing().alias("copy"), F.lit(None).cast("long").alias("mixed"), window.alias("window"))
        )
    return rows.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list("copy").alias("copies"),
        F.collect_set("mixed").alias("mixed"),
        F.collect_list("window").alias("windows"),
    )


def _nothing():
    return F.lit(None).cast("struct<hash: bigint, first: bigint, at: bigint>")


def _with_known(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    joined = docs.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(per_doc, "_id", how)
    return joined.select(
        "doc_id",
        "text",
        "mixed",
        F.col("copies.hash").alias("copies_hash"),
        F.col("copies.first").alias("copies_first"),
        F.col("copies.at").alias("copies_at"),
        F.col("windows.hash").alias("windows_hash"),
        F.col("windows.first").alias("windows_first"),
        F.col("windows.at").alias("windows_at"),
    )


def _open_windows(docs: DataFrame, known: DataFrame, width: int, anchor: int) -> DataFrame:
    """(window, least, place, others), combined by task: windows that phrases leave undecided.

    Only documents with an anchor that is known with other phrases have any.
    """
    rows = _with_known(docs, _per_doc(known).where("size(mixed) > 0"), "inner")

    def flushed(held):
        out = _combined([np.concatenate(c) for c in zip(*held, strict=True)])
        return {"window": out["keys"][0], "least": out["id"], "place": out["place"], "others": out["others"]}

    def run(parts):
        held: list[list[np.ndarray]] = []
        size = 0
        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("text", "copies_hash", "mixed")]
            for doc_id, text, copies, mixed in zip(_ids(part).tolist(), *columns, strict=True):
                words = Words(text)
                anchors, hashes, first, last = words.phrases(width, anchor)
                still = np.isin(_signed(anchors), _longs(mixed)) & ~np.isin(_signed(hashes), _longs(copies))
                place = np.flatnonzero(np.repeat(still, last - first + 1))
                windows = _signed(words.windows(width)[place])
                held.append([windows, np.full(len(windows), doc_id), place])
                size += len(windows)
            if size >= COMBINE:
                yield flushed(held)
                held, size = [], 0
        if held:
            yield flushed(held)

    return by_task(rows, run, "window long, least long, place long, others binary")


def _parsed(docs: DataFrame, per_doc: DataFrame, width: int, anchor: int, shape) -> DataFrame:
    """The factors of every document and what is left of it."""

    def run(part: pa.RecordBatch):
        names = ("text", "copies_hash", "copies_first", "copies_at", "windows_hash", "windows_first", "windows_at")
        out = []
        for text, *known in zip(*[part.column(c).to_pylist() for c in names], strict=True):
            reference = place = np.zeros(0, np.int64)
            if known[0] or known[3]:  # else nothing of it stands in a smaller document
                hashes, firsts, at, windows, window_firsts, window_at = map(_longs, known)
                words = Words(text)
                _, phrases, first, last = words.phrases(width, anchor)
                each = last - first + 1
                by_phrase, at_phrase = (np.repeat(x, each) for x in _lookup(hashes, [firsts, at], _signed(phrases)))
                at_phrase = at_phrase + np.arange(len(at_phrase)) - np.repeat(first, each)
                by_window, at_window = _lookup(windows, [window_firsts, window_at], _signed(words.windows(width)))
                reference = np.where(by_phrase == NONE, by_window, by_phrase)
                place = np.where(by_phrase == NONE, at_window, at_phrase)
            out.append(_settled(text, reference, place, width, shape))
        return {k: [r[k] for r in out] for k in ("n_words", "n_removed", "kept", "factors")} | {
            "doc_id": part.column("doc_id")
        }

    return by_slice(_with_known(docs, per_doc, "left"), run, _RESULT)


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    anchor: int = ANCHOR,
    digest: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (text) and factors.

    A factor is (first word, words, smaller document that has them, their first word there). With
    ``digest``, kept is the SHA-256 of the text.
    """
    spark, rows = docs.sparkSession, id_and_text(docs, id_col, text_col)
    known = stage(_known(phrase_entries(rows, width, anchor)), "phrases")
    release(spark)
    entries = _open_windows(rows, known, width, anchor)
    least = F.min(F.struct("least", "place")).over(Window.partitionBy("window"))
    judged = entries.withColumn("_first", least).withColumns(
        {"first": F.col("_first.least"), "at": F.col("_first.place")}
    )
    spread = _spread(judged.where("others IS NOT NULL OR least <> first"), "window", "first", "at")
    found = stage(spread.where("doc_id <> first"), "windows")
    release(spark)
    copies = known.where("first <> doc_id")
    return _parsed(rows, _per_doc(copies, found), width, anchor, kept_digest if digest else str)


def kept_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
