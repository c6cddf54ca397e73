"""Packing: cutting-stock column generation over a histogram of piece lengths.

A document's ids, with an end id, are cut into full sequences and a rest. The lengths of all pieces
make a histogram of ``unit`` wide classes. On it a linear program finds how often each pattern
(a set of classes that fits one sequence) is used: a knapsack dynamic program over the dual prices
proposes columns until none improves. Pattern counts are rounded down, what is left over is packed
best fit by class, and the rows of each class, ranked by id, are dealt to the patterns' places by
arithmetic on their rank. Only the histogram (at most capacity / unit classes) and the patterns reach
the driver, whatever the input's size.

Defined cases: null and empty texts are a lone end id; a text of any length is cut, never dropped;
repeated rows are packed as often as they stand; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from ..session import stage
from .bpe import byte_symbols
from .common import by_task, id_and_text

CAPACITY, UNIT, END_ID = 2048, 8, 1
CACHE_CHUNKS = 400_000

# Fixed pattern of the byte vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- token ids -------------------------------------------------------------------------


@dataclass(frozen=True)
class ByteVocabulary:
    ranks: dict[bytes, int]
    specials: dict[str, int]


def load_byte_vocabulary(path: str) -> ByteVocabulary:
    """Read a tokenizers file whose merges are in order of their ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    back = {s: b for b, s in enumerate(byte_symbols())}
    ids = spec["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [ids[a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError("ids are not in order of the merges")
    ranks = {bytes(back[c] for c in token): i for token, i in ids.items()}
    return ByteVocabulary(ranks, {t["content"]: t["id"] for t in spec["added_tokens"]})


class ByteEncoder:
    """Ids of texts as little-endian 32-bit integers; ids of repeated chunks are kept.

    A text is cut before each space that follows a character other than white space: no piece of
    the pattern reaches over such a place, so the chunks can be encoded one by one.
    """

    def __init__(self, vocabulary: ByteVocabulary):
        self.coding = tiktoken.Encoding(
            "bytes", pat_str=PIECES, mergeable_ranks=vocabulary.ranks, special_tokens={}
        )
        self.specials = vocabulary.specials
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.wide = re.compile(r"\s ")
        self.cut = re.compile(r"(?<=\S)(?= )")
        self.chunks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not self.special or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join(
            self.specials[p].to_bytes(4, "little") if i % 2 else self.plain(p) for i, p in enumerate(parts)
        )

    def plain(self, text: str) -> bytes:
        if self.wide.search(text):
            first, *rest = self.cut.split(text)
            rest = [c[1:] for c in rest]
        else:
            first, *rest = text.split(" ")
            if not first and rest:
                first = " " + rest.pop(0)
        new = set(rest).difference(self.chunks)
        if len(self.chunks) + len(new) > CACHE_CHUNKS:
            self.chunks, new = {}, set(rest)
        one = self.coding.encode_ordinary
        for chunk in new:
            self.chunks[chunk] = array("I", one(" " + chunk)).tobytes()
        return b"".join([array("I", one(first)).tobytes(), *map(self.chunks.__getitem__, rest)])


def pieces(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Full sequences and the rest of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    vocabulary = load_byte_vocabulary(vocabulary_path)
    end = end_id.to_bytes(4, "little")

    def run(parts):
        coder = ByteEncoder(vocabulary)
        for part in parts:
            out = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            texts = part.column("text").to_pylist()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = coder.encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(own) // 4)
                    out["ids_crc32"].append(zlib.crc32(own))
                    out["doc_tokens"].append(total)
            yield out

    return by_task(
        id_and_text(docs, id_col, text_col),
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
    )


# --- patterns --------------------------------------------------------------------------


def best_pattern(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: value and class counts of the best set of sizes 1..len(prices)."""
    best, taken = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    for c in range(1, room + 1):
        sizes = min(c, len(prices))
        worth = best[c - sizes : c][::-1] + prices[:sizes]
        k = int(worth.argmax())
        best[c], taken[c] = (worth[k], k + 1) if worth[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(len(prices), dtype=np.int64), room
    while c > 0:
        if taken[c]:
            counts[taken[c] - 1] += 1
            c -= taken[c]
        else:
            c -= 1
    return float(best[room]), counts


def fractional_patterns(
    demand: np.ndarray, room: int, gap: float = 1e-3
) -> list[tuple[np.ndarray, float]]:
    """Column generation: (class counts, times used) of the linear program's basis.

    Prices divided by the best pattern's value are feasible for the dual program, so once that value
    is at most 1 + ``gap`` the sequences are at most that share above the optimum.

    ``demand[i]`` pieces have size i + 1. A revised simplex method with an explicit inverse; the
    basis has one column for each class in demand.
    """
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return []
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = room // (classes + 1)
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ demand[classes].astype(float)
    prices = np.zeros(len(demand))
    for _ in range(50 * m + 100):
        prices[classes] = inverse.sum(axis=0)
        value, counts = best_pattern(np.maximum(prices, 0), room)
        if value <= 1 + gap:
            break
        column = counts[classes].astype(float)
        direction = inverse @ column
        limits = np.where(direction > 1e-9, amount / np.maximum(direction, 1e-9), np.inf)
        out = int(limits.argmin())
        if not np.isfinite(limits[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        amount = np.maximum(amount - limits[out] * direction, 0)
        amount[out] = limits[out]
    found = []
    for j in range(m):
        counts = np.zeros(len(demand), dtype=np.int64)
        counts[classes] = basis[:, j].astype(np.int64)
        found.append((counts, float(amount[j])))
    return found


def plan_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers: (class counts, sequences) that hold every piece of ``demand`` exactly once."""
    left, plan = demand.astype(np.int64).copy(), []
    for counts, amount in fractional_patterns(demand, room):
        used = np.flatnonzero(counts)
        times = min(int(amount + 1e-6), int((left[used] // counts[used]).min()))
        if times > 0:
            plan.append((counts, times))
            left -= counts * times
    # Best fit of the rest, largest first: fewer than one pattern's content for each class.
    open_by_room: dict[int, list[np.ndarray]] = {}
    for i in np.flatnonzero(left)[::-1].tolist():
        for _ in range(int(left[i])):
            size = i + 1
            fits = min((r for r in open_by_room if r >= size), default=None)
            if fits is None:
                box, space = np.zeros(len(demand), dtype=np.int64), room
            else:
                box, space = open_by_room[fits].pop(), fits
                if not open_by_room[fits]:
                    del open_by_room[fits]
            box[i] += 1
            open_by_room.setdefault(space - size, []).append(box)
    plan += [(box, 1) for boxes in open_by_room.values() for box in boxes]
    return plan


def places(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, pieces a sequence, first slot) of each use.

    The ranks of a class are dealt to the patterns that use it, in order.
    """
    dealt: dict[int, int] = {}
    out, sequence = [], 0
    for counts, times in plan:
        slot = 0
        for i in np.flatnonzero(counts).tolist():
            each = int(counts[i])
            first = dealt.get(i, 0)
            dealt[i] = first + each * times
            out.append((i + 1, first, dealt[i], sequence, each, slot))
            slot += each
        sequence += times
    return out


def packed(
    cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT
) -> DataFrame:
    """Add sequence_id and offset to pieces: doc_id, start, length and any other columns."""
    if capacity % unit:
        raise ValueError("the capacity is no multiple of the unit")
    spark: SparkSession = cut.sparkSession
    classed = stage(cut.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    counts = classed.groupBy("_class").count().collect()  # at most capacity / unit rows
    demand = np.zeros(capacity // unit, dtype=np.int64)
    for row in counts:
        demand[row["_class"] - 1] = row["count"]
    uses = places(plan_patterns(demand, capacity // unit))
    spots = spark.createDataFrame(
        uses, "_own int, _first long, _end long, _sequence long, _each long, _slot long"
    )
    ranked = positions(classed, ["_class"], ["doc_id", "start"], "_rank")
    rank = F.col("_rank") - 1
    # One use of one class in a pattern is a row; there are no more than (capacity / unit)^2.
    dealt = ranked.join(
        F.broadcast(spots), (F.col("_class") == F.col("_own")) & (rank >= F.col("_first")) & (rank < F.col("_end"))
    )
    at = rank - F.col("_first")
    placed = dealt.withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_each"))).withColumn(
        "_slot", F.col("_slot") + at % F.col("_each")
    )
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        *cut.columns,
        "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"),
    )
