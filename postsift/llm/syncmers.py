"""Document fingerprints: closed syncmers, matched by position.

A k-mer of a text's bytes is a closed syncmer if the least hash among its s-mers belongs to the first
or the last of them. That depends on the k-mer alone, so equal passages have equal anchors wherever
they stand. A fingerprint keeps all anchors of a text, in order of their place, each with its byte
offset, so it grows with the text. Two fingerprints are compared by the anchors that both have, as far
as these stand in the same order: the longest such chain against all that could have matched. An anchor
that repeats counts as often as it stands there; its first place is matched with the other text's first,
its second with the second.

Defined cases: null counts as empty; the empty text has the empty fingerprint, which is like itself
and unlike all others; a text shorter than k, or without a closed syncmer, is its own anchor; a
text of any length is read whole, with the same k and s; a single row is followed by itself; rows that
repeat an id follow each other in an order of their texts; a null id comes before all others; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_task, id_and_text

K, S = 12, 4

# Rows a block of neighbouring ids should have, and how many blocks there may be. The bounds and the
# first id of each block pass through the driver, so they are a few megabytes whatever the input.
BLOCK_ROWS, MOST_BLOCKS = 250, 65_536
NO_ID = -(1 << 63)  # stands for a null id

_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` bytes at each place."""
    n = len(data) - width + 1
    values = _BYTE[data]
    out = values[:n].copy()
    for j in range(1, width):
        out *= _BASE
        out += values[j : j + n]
    return _mixed(out)


def _run_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[: len(x) - step], x[step:])
        span += step
    return x


def anchors(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offset) of the closed syncmers of ``data``, in order of offset."""
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) < k:
        return _hashes(raw, len(raw)), np.zeros(1, np.int64)
    small = _hashes(raw, s)
    least = _run_least(small, k - s + 1)
    n = len(least)
    place = np.flatnonzero((small[:n] == least) | (small[k - s :] == least))
    if not len(place):  # fewer than k + k - s - 1 bytes, with the least s-mer inside every k-mer
        return _hashes(raw, len(raw)), np.zeros(1, np.int64)
    values = _BYTE[raw]
    out = values[place].copy()
    for j in range(1, k):
        out *= _BASE
        out += values[place + j]
    return _mixed(out), place


def fingerprint(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash, offset) of all anchors, in order of offset."""
    hashes, places = anchors(data)
    return (hashes >> np.uint64(32)).astype(np.uint32), places


def text_of(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of the number of anchors, their hashes, and the gaps between offsets.

    Little-endian, four bytes each; a gap below 255 has one byte, others 255 there and four at the end.
    """
    hashes, places = print_
    if not len(hashes):
        return ""
    gaps = np.diff(places, prepend=0)
    packed = [
        np.array([len(hashes)], "<u4"), hashes.astype("<u4"), np.minimum(gaps, 255).astype("u1"), gaps[gaps >= 255].astype("<u4")
    ]
    return base64.b64encode(b"".join(x.tobytes() for x in packed)).decode()


def of_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint that ``text_of`` has written."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    data = base64.b64decode(text)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    gaps = np.frombuffer(data, "u1", n, 4 + 4 * n).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<u4", offset=4 + 5 * n)
    return np.frombuffer(data, "<u4", n, 4), np.cumsum(gaps)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of matching anchors, 0 to 1 (Dice).

    The anchors that both have are matched by position: the longest chain in the same order on both
    sides counts.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, in_a, in_b = np.intersect1d(_numbered(a[0]), _numbered(b[0]), assume_unique=True, return_indices=True)
    places = b[1][in_b[np.argsort(in_a)]]
    return 2 * _longest(places) / (len(a[0]) + len(b[0]))


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Every hash with the number of equal ones before it."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(fresh)
    number = np.arange(len(hashes)) - np.repeat(first, np.diff(first, append=len(hashes)))
    out = np.empty(len(hashes), dtype=np.uint64)
    out[order] = (ordered.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
    return out


def _longest(places: np.ndarray) -> int:
    """Length of the longest ascending chain."""
    if (places[1:] > places[:-1]).all():
        return len(places)
    chain: list[int] = []
    for p in places.tolist():
        at = bisect_left(chain, p)
        chain[at : at + 1] = [p]
    return len(chain)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many, or all, of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows in blocks of neighbouring ids, each block followed by the row after its last one.

    Columns: block, doc_id, text, extra (true for that last row). Blocks are cut at quantiles of the
    ids, so they have about as many rows each however the ids lie; only rows of one and the same id
    cannot be parted. Texts are shuffled once.
    """
    rows = docs.count()
    blocks = max(1, min(MOST_BLOCKS, rows // block_rows))
    shares = [i / blocks for i in range(1, blocks)]
    cut = F.percentile_approx("doc_id", shares, max(10_000, 4 * blocks)) if shares else F.array()
    bounds = np.unique(np.array(docs.agg(cut).first()[0] or [], dtype=np.int64))

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    placed = docs.withColumn("block", block_of(F.coalesce("doc_id", F.lit(NO_ID))))
    placed = placed.withColumn("order", F.xxhash64("text"))  # rows that repeat an id
    firsts = (
        placed.groupBy("block")
        .agg(F.min(F.struct(F.col("doc_id"), F.col("order"))).alias("first"))
        .select("block", "first.*")
        .orderBy("block")
        .collect()
    )
    # The first row of each block also goes to the block before; that of the first, to the last.
    moves = [
        (row["block"], row["doc_id"], row["order"], firsts[i - 1]["block"]) for i, row in enumerate(firsts)
    ]
    spark = docs.sparkSession
    to = F.broadcast(spark.createDataFrame(moves, "_block long, _id long, _order long, _to long"))
    also = (
        placed.join(
            to,
            (F.col("block") == F.col("_block"))
            & F.col("doc_id").eqNullSafe(F.col("_id"))
            & (F.col("order") == F.col("_order")),
            "left",
        )
    )
    targets = F.array_compact(
        F.array(
            F.struct(F.col("block"), F.lit(False).alias("extra")),
            F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("block"), F.lit(True).alias("extra"))),
        )
    )
    return also.select("doc_id", "text", "order", F.explode(targets).alias("target")).select(
        "target.block", "target.extra", "doc_id", "order", "text"
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited (text's digest), both fingerprints, likenesses.

    near_edited compares a text with its edited form, near_next with the next document.
    """
    placed = neighbours(id_and_text(docs, id_col, text_col))
    sorted_rows = placed.repartition("block").sortWithinPartitions("block", "extra", "doc_id", "order")

    def run(parts):
        waiting = None  # the row whose follower is to come: (block, id, text, fingerprint)
        for part in parts:
            out = {
                k: []
                for k in (
                    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
                )
            }
            names = ("block", "extra", "doc_id", "text")
            for block, extra, doc_id, text in zip(*[part.column(c).to_pylist() for c in names], strict=True):
                own = fingerprint(text.encode())
                # An extra row only ends its block; a repeat of it (same id and text) changes nothing.
                if waiting is not None and waiting[0] == block:
                    _, before_id, before, before_print = waiting
                    new = edited(before, text)
                    new_print = fingerprint(new.encode())
                    out["doc_id"].append(before_id)
                    out["n_chars"].append(len(before))
                    out["edited_sha256"].append(hashlib.sha256(new.encode()).hexdigest())
                    out["fingerprint"].append(text_of(before_print))
                    out["edited_fingerprint"].append(text_of(new_print))
                    out["near_edited"].append(likeness(before_print, new_print))
                    out["near_next"].append(likeness(before_print, own))
                waiting = None if extra else (block, doc_id, text, own)
            yield out

    return by_task(
        sorted_rows.select("block", "extra", "doc_id", "text"),
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
