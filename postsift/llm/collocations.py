"""Phrase collocations by SON partitioning.

Documents are dealt into a fixed number of shards by their id. A phrase that occurs ``support`` times
in all occurs at least ``support / shards`` times in one of them, however unevenly the shards share
it, so every shard is mined completely at that lowered local support:

1. Single words and pairs are counted by shard.
2. Of phrases of three words and more, those whose pairs are all locally frequent in the shard.
3. The union of the locally frequent phrases is the candidate set; all occurrences of all candidates
   are counted over the whole table, by their text.

The number of shards does not grow with the input, so the local support stays above one; a shard is
counted by as many tasks as Spark gives it, not held in one. Mining works on 64-bit hashes, counted in
runs before they are shuffled; what it hands on is a bit table of the locally frequent hashes. Both
hashes and bits can only let more phrases through, and everything that gets through is counted
exactly by text, so the result is exact. The bit table has 16 bits a hash and at most 2**30 bits
(128 MB); beyond that it fills up, and more phrases than needed are counted.

Scores are worked out from the counts alone, with joins on the parts of each phrase.

Defined cases: null text counts as empty, a null language as ``und``; a language without frequent
phrases gives no rows; rows that repeat an id count each; ties go by count, then by the bytes of the
phrase; texts longer than a slice are cut between pieces; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import by_task

LONGEST = 4  # words of a phrase
SHARDS = 3  # 30 / 3: a local support of 10

# Bytes of text that are hashed at once; hashes a task holds before it counts them, and different
# phrases it holds before it hands them on.
SEGMENT = 2 << 20
COMBINE = 1 << 22
HELD = 1 << 20

# Parts in which the best phrases of a language are sought before they are ranked together.
RANKED_IN = 16

MOST_BITS = 1 << 30
_SHARD_MASK = np.uint64(15)
_BY_SHARD = 0x9E3779B1  # moves the bit of a hash to another place in every shard

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_VALUES = np.where(_KIND == _WORD, _mixed(np.arange(1, 257, dtype=np.uint64)), np.uint64(0))


@dataclass
class Row:
    lang: str
    shard: int
    text: bytes


def _rows(part: pa.RecordBatch, segment: int) -> Iterator[Row]:
    """Rows of a slice, long texts cut at ends of pieces; a piece that is longer stays whole."""
    texts = part.column("text").cast(pa.binary()).to_pylist()
    for lang, shard, text in zip(
        part.column("lang").to_pylist(), part.column("shard").to_pylist(), texts, strict=True
    ):
        start = 0
        while len(text) - start > segment:
            end = _ENDS.search(text, start + segment)
            if end is None:
                break
            yield Row(lang, shard, text[start : end.start()])
            start = end.start()
        yield Row(lang, shard, text[start:] if start else text)


def _segments(parts: Iterator[pa.RecordBatch], segment: int) -> Iterator[list[Row]]:
    held: list[Row] = []
    size = 0
    for part in parts:
        for row in _rows(part, segment):
            if held and size + len(row.text) > segment:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row.text) + 1
    if held:
        yield held


class Words:
    """Words of a segment's texts, A-Z lower-cased, with hashes of every phrase."""

    def __init__(self, rows: list[Row]):
        joined = b"\n".join(row.text for row in rows).lower() + b"\n"  # bytes.lower() knows A-Z only
        data = np.frombuffer(joined, dtype=np.uint8)
        kind = _KIND[data]
        word = kind == _WORD
        edges = np.flatnonzero(np.diff(word, prepend=False))
        self.starts, self.stops = edges[::2], edges[1::2]
        self.data, self.word = data, word
        row_starts = np.cumsum([0, *[len(row.text) + 1 for row in rows[:-1]]])
        self.row = np.searchsorted(row_starts, self.starts, side="right") - 1
        self.langs, codes = np.unique([row.lang for row in rows], return_inverse=True)
        self.lang = codes.astype(np.int32)[self.row]
        self.shard = np.array([row.shard for row in rows], dtype=np.uint64)[self.row]
        self.piece = np.cumsum(kind == _BREAK)[self.starts]
        seeds = np.array([_seed(lang) for lang in self.langs], dtype=np.uint64)
        n = len(self.starts)
        if n:
            sums = np.add.reduceat(_VALUES[data] * _powers(_ODD, len(data)), self.starts)
            self.hash = _mixed(sums * _powers(_INVERSE, len(data))[self.starts])
        else:
            self.hash = np.zeros(0, np.uint64)
        self._seeded = seeds[self.lang] if n else self.hash

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to ``longest`` words: hash by first word, and whether the words are in one piece."""
        grown = self._seeded
        for k in range(1, longest + 1):
            n = max(0, len(self) - k + 1)
            grown = _mixed((grown[:n] ^ self.hash[k - 1 :][:n]) * _ODD)
            yield k, grown, self.piece[:n] == self.piece[k - 1 :][:n]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes with their shard in the last four bits."""
        return (hashes & ~_SHARD_MASK) | self.shard[: len(hashes)]

    def spaced(self) -> None:
        """Have the words stand one space apart, so that every phrase is a run of bytes."""
        keep = self.word.copy()
        keep[self.stops] = True
        data = self.data.copy()
        data[self.stops] = 0x20
        self.data = data[keep]
        lengths = self.stops - self.starts
        self.stops = np.cumsum(lengths + 1) - 1
        self.starts = self.stops - lengths

    def texts(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words that start at the words ``first``; after ``spaced``."""
        begin, lengths = self.starts[first], self.stops[first + k - 1] - self.starts[first]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], lengths)
        return pa.Array.from_buffers(
            pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])]
        )


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Bits:
    """A bit table over hashes; two bits a hash."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(8 * len(table) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        in_shard = (keys >> np.uint64(4)) ^ ((keys & _SHARD_MASK) * np.uint64(_BY_SHARD))
        for place in (in_shard & self.mask, (keys >> np.uint64(34)) & self.mask):
            byte = self.table[(place >> np.uint64(3)).astype(np.int64)]
            found &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bits_of(keys: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """The table of the longs in ``keys.key``, built as bitmaps of 4 KB; its size is bounded."""
    n = 1 << 18
    count = keys.count()
    while n < 16 * count and n < most_bits:
        n *= 2
    key, by_shard = F.col("key"), F.col("key").bitwiseAND(15) * F.lit(_BY_SHARD)
    in_shard = F.shiftrightunsigned(key, 4).bitwiseXOR(by_shard)
    places = F.array(in_shard.bitwiseAND(n - 1), F.shiftrightunsigned(key, 34).bitwiseAND(n - 1))
    maps = (
        keys.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 15).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << 15) - 1)).alias("bits"))
    )
    table = np.zeros(n // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        table[row.bucket * 4096 : (row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return table


def _counted(held: list[np.ndarray]) -> dict[str, object]:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return {"key": keys.view(np.int64), "n": n}


def _locally_frequent(docs: DataFrame, keys_of, least: int, segment: int) -> DataFrame:
    """(key) of the phrases that ``keys_of`` finds ``least`` times in a shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        held: list[np.ndarray] = []
        for rows in _segments(parts, segment):
            held.extend(keys_of(Words(rows)))
            if sum(map(len, held)) >= COMBINE:
                yield _counted(held)
                held = []
        if held:
            yield _counted(held)

    counts = by_task(docs, run, "key long, n long")
    # Tasks have counted their own runs; an aggregation before the exchange would find few repeats.
    return counts.repartition("key").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def mined(docs: DataFrame, support: int, shards: int, longest: int, segment: int = SEGMENT) -> DataFrame:
    """(key) of every phrase that is frequent in its shard."""
    if not 1 <= shards <= 16:
        raise ValueError("1 to 16 shards")
    least = -(-support // shards)
    sc = docs.sparkSession.sparkContext

    def short(words: Words) -> Iterator[np.ndarray]:
        for _, hashes, inside in words.grams(min(2, longest)):
            yield words.keys(hashes)[inside]

    frequent = stage(_locally_frequent(docs, short, least, segment), "frequent")
    if longest <= 2:
        return frequent
    pairs = sc.broadcast(bits_of(frequent))

    def long(words: Words) -> Iterator[np.ndarray]:
        known = Bits(pairs.value)
        alive = np.zeros(0, dtype=bool)
        for k, hashes, inside in words.grams(longest):
            if k == 2:
                pair = alive = known.has(words.keys(hashes)) & inside
            elif k > 2:
                alive = alive[: len(hashes)] & pair[k - 2 :][: len(hashes)] & inside
                yield words.keys(hashes)[alive]

    return frequent.unionByName(stage(_locally_frequent(docs, long, least, segment), "frequent-long"))


def counted(
    docs: DataFrame, frequent: DataFrame, support: int, longest: int, segment: int = SEGMENT
) -> DataFrame:
    """(lang, phrase, n) of every phrase of 1 to ``longest`` words with ``support`` uses.

    A null phrase carries the number of all words of the language.
    """
    shared = F.col("key").bitwiseAND(~15)
    candidates = docs.sparkSession.sparkContext.broadcast(bits_of(frequent.select(shared.alias("key")).distinct()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        known = Bits(candidates.value)
        held: list[pa.Table] = []
        for rows in _segments(parts, segment):
            words = Words(rows)
            words.spaced()
            total = np.bincount(words.lang, minlength=len(words.langs))
            held.append(_found(words.langs, np.arange(len(total)), None, total))
            for k, hashes, inside in words.grams(longest):
                first = np.flatnonzero(known.has(hashes & ~_SHARD_MASK) & inside)
                held.append(_found(words.langs, words.lang[first], words.texts(first, k), None))
            if sum(t.num_rows for t in held[1:]) >= HELD:
                held = [_summed(held)]
                if held[0].num_rows >= HELD:
                    yield _columns(held[0])
                    held = []
        if held:
            yield _columns(_summed(held))

    occurrences = by_task(docs, run, "lang string, phrase string, n long")
    total = occurrences.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return total.where((F.col("n") >= support) | F.col("phrase").isNull())


def _found(langs: np.ndarray, codes: np.ndarray, phrases: pa.Array | None, n: np.ndarray | None) -> pa.Table:
    """Occurrences of one length, summed."""
    names = pa.array(langs.tolist(), pa.string()).take(pa.array(codes, pa.int32()))
    if phrases is None:
        phrases = pa.nulls(len(codes), pa.large_string())
    n = pa.array(np.ones(len(codes), np.int64) if n is None else n, pa.int64())
    return _summed([pa.table({"lang": names.dictionary_encode(), "phrase": phrases, "n": n})])


def _summed(tables: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(t.set_column(0, "lang", t.column("lang").cast(pa.string())) for t in tables)
    return table.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])


def _columns(table: pa.Table) -> dict[str, object]:
    return {
        "lang": table.column("lang").combine_chunks(),
        "phrase": table.column("phrase").cast(pa.string()).combine_chunks(),
        "n": table.column("n").combine_chunks(),
    }


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored(counts: DataFrame, share: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one takes along."""
    words = counts.where("phrase IS NOT NULL").withColumn("words", F.split("phrase", " "))
    phrases = words.where(F.size("words") > 1).withColumnRenamed("n", "a")

    def run(first: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", first, length), " ")

    size = F.size("words")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, size).alias("right")
    )
    part = counts.where("phrase IS NOT NULL")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("(2000000 * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    least = cuts.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), size - 1),
                lambda length: F.transform(F.sequence(F.lit(1), size - length + 1), lambda at: run(at, length)),
            )
        )
    )
    longer = phrases.where(size > 2).select("lang", inner.alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("of_longer"))
    taken = F.coalesce(100 * _exact("of_longer") >= share * _exact("a"), F.lit(False))
    return least.join(longer, ["lang", "phrase"], "left").where(~taken).select("lang", "phrase", "a", "cut.*")


def collocations(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = 30,
    longest: int = LONGEST,
    top: int = 2000,
    shards: int = SHARDS,
    share: int = 80,
    segment: int = SEGMENT,
) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(docs[id_col]), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    frequent = mined(rows, support, shards, longest, segment)
    counts = stage(counted(rows, frequent, support, longest, segment), "counts")
    words = counts.where("phrase IS NULL").select("lang", F.col("n").alias("of_lang"))
    found = scored(counts, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    for keys in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return found.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("of_lang").alias("n"), "score"
    )
