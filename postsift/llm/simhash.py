"""SimHash near-dedup: fingerprints are linked through a hierarchical index in Gray order.

Fingerprints are reduced to the distinct ones. If two differ in at most ``d`` bits, they agree on at
least one of d + 1 bands, so each goes to a bucket for each band. A bucket with more than ``most``
fingerprints is dealt further by the same argument on its remaining bits, until it is small enough or
its bits run out. In a bucket the fingerprints are sorted by Gray rank, which puts similar ones next
to each other, and grouped in a tree: a node holds the bits that all fingerprints below it share.
A search goes down all levels at once, adds up differences on shared bits from level to level and
drops a whole group as soon as the sum exceeds ``d``. What a bucket finds leaves it as a forest with
at most one edge a fingerprint, never as all pairs; star contraction joins the forests.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other;
fewer words than a shingle are one shingle; rows that repeat an id share its component; null ids have
a fingerprint but never name a component unless it has no other id; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_slice, id_and_text
from .components import components

SHINGLE, MOST_BITS, SEED, BITS = 4, 4, 42, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set where more than half of the shingles' hashes have it set."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        data = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        cut = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(data[a:b], SEED) for a, b in cut]
    counts = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for i in range(0, len(values), 1 << 16):  # a long text's bits are not spread out all at once
        part = values[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``bits``, the fingerprint as a signed long."""

    def run(part: pa.RecordBatch):
        values = [fingerprint_of(t, shingle) for t in part.column("text").to_pylist()]
        return {
            "doc_id": part.column("doc_id"),
            "bits": [v - (1 << 64) if v >> 63 else v for v in values],
        }

    return by_slice(id_and_text(docs, id_col, text_col), run, "doc_id long, bits long")


# --- the index of one bucket -----------------------------------------------------------


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray order."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Tree over fingerprints in Gray order; ``levels`` runs from the roots to the leaves.

    Each level has, per node, the bits shared by all below (``mask``), their values (``pattern``),
    and the mask without the bits that the parent has already compared (``fresh``).
    """

    def __init__(self, values: np.ndarray, fan: int = 8):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.fan = fan
        mask, pattern = np.full(len(values), ~np.uint64(0)), self.values
        levels = [(mask, pattern)]
        while len(pattern) > fan:
            cuts = np.arange(0, len(pattern), fan)
            ones = np.bitwise_and.reduceat(pattern & mask, cuts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)
            mask, pattern = ones | zeros, ones
            levels.append((mask, pattern))
        self.levels = []
        above = None
        for mask, pattern in reversed(levels):
            parent = np.arange(len(mask)) // fan
            fresh = mask if above is None else mask & ~above[parent]
            self.levels.append((pattern, fresh))
            above = mask

    def links(self, most: int, pairs: int = 1 << 21):
        """Yield (i, j), positions of fingerprints with i < j within ``most`` bits, in blocks.

        A block looks at no more than about ``pairs`` pairs at once, even if no group can be dropped.
        """
        step = max(1, pairs // len(self.values))
        for first in range(0, len(self.values), step):
            query = np.arange(first, min(first + step, len(self.values)))
            pattern, fresh = self.levels[0]
            who = np.repeat(query, len(pattern))
            node = np.tile(np.arange(len(pattern)), len(query))
            apart = np.zeros(len(who), dtype=np.uint8)
            for depth, (pattern, fresh) in enumerate(self.levels):
                if depth:
                    child = (node[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
                    who, apart = np.repeat(who, self.fan), np.repeat(apart, self.fan)
                    real = child < len(pattern)
                    # Leaves under a node start at its number times the fan to the levels below.
                    span = self.fan ** (len(self.levels) - 1 - depth)
                    real &= (child + 1) * span > who  # only partners that come later
                    who, node, apart = who[real], child[real], apart[real]
                apart = apart + np.bitwise_count((self.values[who] ^ pattern[node]) & fresh[node])
                near = apart <= most
                who, node, apart = who[near], node[near], apart[near]
            later = node > who
            yield who[later], node[later]


def forest(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (value, least value of its group) of the groups linked within one bucket."""
    index = GrayIndex(values)
    group = np.arange(len(values))
    for left, right in index.links(most):
        pairs = np.column_stack([group[left], group[right]])
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        if not len(pairs):
            continue
        parent: dict[int, int] = {}

        def top(i: int, parent=parent) -> int:
            while (above := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[above]
            return i

        for i, j in pairs.tolist():
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
        renamed = np.arange(len(values))
        for i in parent:
            renamed[i] = top(i)
        group = renamed[group]
    own = index.values.view(np.int64)
    at = np.flatnonzero(group != np.arange(len(own)))
    return list(zip(own[at].tolist(), own[group[at]].tolist(), strict=True))


# --- buckets -----------------------------------------------------------------------------


def bands(bits: list[int], parts: int) -> list[list[int]]:
    """The bit numbers in ``parts`` runs of nearly equal length."""
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def buckets(distinct: DataFrame, most_bits: int, most: int) -> DataFrame:
    """(band, value, bits): every two fingerprints within ``most_bits`` share a bucket.

    Buckets above ``most`` fingerprints are dealt further by bands of the bits that do not yet
    agree; how many levels that takes depends on the data, so it is counted level by level.
    """
    settled = None
    level = [("", 0, list(range(BITS)))]
    rows = distinct.select(F.lit("").alias("band"), F.lit(0).cast("long").alias("value"), "bits")
    while True:
        finer = [
            (f"{name}{i}", taken | (_mask(band) & ((1 << 64) - 1)), [b for b in left if b not in band])
            for name, taken, left in level
            for i, band in enumerate(bands(left, most_bits + 1))
        ]
        rows = stage(_dealt(rows, finer), "buckets")
        sizes = rows.groupBy("band", "value").count().where(F.col("count") > most)
        hot = stage(sizes.select("band", "value"), "hot")
        may_split = len(finer[0][2]) >= most_bits + 1
        if not may_split or hot.limit(1).count() == 0:
            return rows if settled is None else settled.unionByName(rows)
        small = rows.join(hot, ["band", "value"], "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        rows = rows.join(hot, ["band", "value"], "left_semi")
        level = finer


def _dealt(rows: DataFrame, level: list[tuple[str, int, list[int]]]) -> DataFrame:
    """Each row to the buckets of the next level below its own."""
    masks = F.array(
        *[
            F.struct(F.lit(name).alias("band"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask"))
            for name, m, _ in level
        ]
    )
    under = F.filter(masks, lambda m: F.substring(m["band"], 1, len(level[0][0]) - 1) == F.col("band"))
    return rows.select("bits", F.explode(under).alias("to")).select(
        F.col("to.band").alias("band"), F.col("bits").bitwiseAND(F.col("to.mask")).alias("value"), "bits"
    )


def linked(distinct: DataFrame, most_bits: int = MOST_BITS, most: int = 20_000) -> DataFrame:
    """``distinct`` (bits) to (node, root) of the fingerprints that have a link."""
    placed = buckets(distinct, most_bits, most)
    # Buckets of one fingerprint link nothing.
    shared = placed.groupBy("band", "value").count().where("count > 1").select("band", "value")
    placed = placed.join(shared, ["band", "value"], "left_semi")

    def run(_key, group):
        values = group.column("bits").to_numpy().view(np.uint64)
        edges = forest(values, most_bits)
        return pa.table(
            {
                "a": pa.array([e[0] for e in edges], type=pa.int64()),
                "b": pa.array([e[1] for e in edges], type=pa.int64()),
            }
        )

    return components(placed.groupBy("band", "value").applyInArrow(run, "a long, b long"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, bits, component_id (least id reachable by links)."""
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    firsts = marked.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    roots = linked(firsts.select("bits"), most_bits)
    classes = stage(
        firsts.join(roots, F.col("bits") == F.col("node"), "left").select(
            "bits", "first_id", F.coalesce("root", "bits").alias("root")
        ),
        "classes",
    )
    # Written first, so that the join can split a component that holds most fingerprints.
    least = stage(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = classes.join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select("doc_id", "bits", "component_id")


def hex_of(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``docs`` without the rows whose id is not the least of its component; rows of null id stay."""
    groups = near_groups(docs, id_col, text_col, shingle, most_bits)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("row.*")
