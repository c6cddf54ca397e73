"""LM scoring: cross-entropy difference of two matched n-gram models.

A target model (documents marked as wanted) and a background model (all documents) share one
vocabulary, one set of bigrams and one smoothing, so their losses can be compared token by token. A
document's score is the mean over its tokens of target loss minus background loss, in bits: the lower,
the more it reads like the target.

Nothing is pruned: every word and every pair of the corpus is counted, and scoring looks every one up.
Documents are dealt into blocks of about a million words, written once with their words as numbers. A
block asks for the counts of its distinct words and pairs: it sends their 64-bit hashes, sorted and cut
into buckets, with its own counts; the task of a bucket adds up what all blocks say and answers each of
them in the order in which it asked. Then a block scores its documents alone. A word or pair that very
many documents have is sent once a block, so no key is hot; buckets hold hashes, so they are even, and
their number grows with the words.

Probabilities: unigrams of the background are its relative frequencies. Those of the target have a prior
of ``PRIOR`` words drawn from them, and the bigrams of either model one of ``PRIOR`` words drawn from its
own unigrams. After its last word a text has an end, which is counted and can follow any word, but is
not scored; so after each context the probabilities of all words and the end sum to one. Different words
or pairs with one 64-bit hash would be counted as one.

Defined cases: null and empty texts have no tokens, entropies 0 and score 0; a text of any length is
read whole, in one block; repeated rows count as often as they stand; a null id stays null; ids of the
target that no document has are ignored; without any target document the target model is the
background's unigrams; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import by_task

# Weight of the priors, in words.
PRIOR = 16.0

# Target ids are broadcast up to this number (32 MB), and joined by a shuffle beyond it.
MOST_BROADCAST = 4_000_000

# A block is closed after so many words (one longer text excepted); a bucket gets about so many questions.
BLOCK_WORDS = 1 << 20
BUCKET_KEYS = 1 << 21

RESULT = "doc_id long, n_tokens long, h_target double, h_background double, score double"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def marked(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and whether the document is of the target."""
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("_target")).distinct()
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )
    return rows.join(ids, F.col("doc_id") == F.col("_target"), "left").select(
        "doc_id", "text", F.col("_target").isNotNull().alias("target")
    )


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the first bytes of all numbers, then the second ones, and so on, compressed."""
    out = []
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes()
        small = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out += [struct.pack("<2sqq", array.dtype.str[1:].encode(), len(array), len(small)), small]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, length, size = struct.unpack_from("<2sqq", data, at)
        at += 18
        dtype = np.dtype("<" + kind.decode())
        planes = pa.decompress(data[at : at + size], length * dtype.itemsize, codec="zstd", asbytes=True) if size else b""
        rows = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, length)
        out.append(np.ascontiguousarray(rows.T).reshape(-1).view(dtype))
        at += size
    return out


class _Numbers(dict):
    """Words of a block, numbered as they first appear."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of two 64-bit hashes, in order: multiplied, added and mixed."""
    mixed = context * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(29)))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def blocks(rows: DataFrame) -> DataFrame:
    """(block, n, n_target, texts) of rows with doc_id, text and target.

    ``texts`` packs the words of all texts as numbers (0 before each text and after the last), the words'
    hashes, and each text's id, whether it has one, and whether it is of the target. ``n`` counts words and
    ends of texts.
    """

    def run(parts):
        base = TaskContext.get().partitionId() << 33
        numbers, said, ids, there, wanted = _Numbers({"": 0}), [], [], [], []
        made = size = 0

        def closed():
            sequence = np.concatenate([*said, np.zeros(1, np.uint32)])
            hashes = np.fromiter((_word_hash(w) for w in numbers), np.uint64, len(numbers))
            own = np.concatenate(wanted)
            _, word, text = _events(sequence)
            texts = packed(sequence, hashes, np.concatenate(ids), np.concatenate(there), own)
            return {
                "block": [base + made],
                "n": [len(word)],
                "n_target": [int(own[text].sum())],
                "texts": [texts],
            }

        for part in parts:
            column = part.column("doc_id")
            for i, text in enumerate(part.column("text").to_pylist()):
                found = [0, *[numbers[w] for w in words_of(text)]]
                said.append(np.array(found, dtype=np.uint32))
                size += len(found)
                one = column.slice(i, 1)
                ids.append(one.fill_null(0).to_numpy(zero_copy_only=False))
                there.append(np.array([one.null_count == 0], dtype=np.uint8))
                wanted.append(np.array([part.column("target")[i].as_py()], dtype=np.uint8))
                if size >= BLOCK_WORDS:
                    yield closed()
                    made += 1
                    numbers, said, ids, there, wanted = _Numbers({"": 0}), [], [], [], []
                    size = 0
        if said:
            yield closed()

    return by_task(rows, run, "block long, n long, n_target long, texts binary")


def _events(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and number of its text, of every word and every end of a text that has words."""
    text = np.cumsum(sequence[:-1] == 0) - 1
    kept = (sequence[:-1] != 0) | (sequence[1:] != 0)
    return sequence[:-1][kept].astype(np.int64), sequence[1:][kept].astype(np.int64), text[kept]


class _Block:
    """What a block asks: its words, then its pairs, both distinct; and the order of their hashes."""

    def __init__(self, data: bytes):
        self.sequence, self.hashes, self.ids, self.there, self.wanted = unpacked(data)
        self.context, self.word, self.text = _events(self.sequence)
        size = len(self.hashes)
        self.pairs, self.place = np.unique(self.context * size + self.word, return_inverse=True)
        before, after = np.divmod(self.pairs, size)
        self.before, self.after = before, after
        keys = np.concatenate([self.hashes, _pair_hash(self.hashes[before], self.hashes[after])])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's own counts of what it asks for: in all its texts, and in those of the target."""
        size, n_pairs = len(self.hashes), len(self.pairs)
        own = self.wanted[self.text].astype(bool)
        return tuple(
            np.concatenate(
                [np.bincount(self.word[rows], minlength=size), np.bincount(self.place[rows], minlength=n_pairs)]
            )[self.order].astype(np.uint32)
            for rows in (slice(None), own)
        )


def questions(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, bucket, asked): differences of the sorted hashes whose first ``bits`` are the bucket's, and counts."""

    def run(parts):
        for part in parts:
            for number, data in zip(part.column("block").to_pylist(), part.column("texts").to_pylist(), strict=True):
                block = _Block(data)
                n, n_target = block.counts()
                bucket = (block.keys >> np.uint64(64 - bits)) if bits else np.zeros(len(block.keys), np.uint64)
                first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
                asked = []
                for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
                    asked.append(packed(np.diff(block.keys[a:b], prepend=np.uint64(0)), n[a:b], n_target[a:b]))
                yield {"block": [number] * len(first), "bucket": bucket[first].astype(np.int64), "data": asked}

    return by_task(blocks.select("block", "texts"), run, "block long, bucket long, data binary")


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, data): the counts over all blocks, in the order of the block's question."""

    def answer(data: list[bytes]) -> list[bytes]:
        gaps, n, n_target = zip(*map(unpacked, data), strict=True)
        keys = np.concatenate([np.cumsum(g, dtype=np.uint64) for g in gaps])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        runs = np.diff(first, append=len(keys))
        ends = np.cumsum([len(g) for g in gaps])[:-1]
        sums = []
        for counts in (n, n_target):
            total = np.add.reduceat(np.concatenate(counts)[order].astype(np.uint64), first)
            back = np.empty(len(keys), np.uint64)
            back[order] = np.repeat(total, runs)
            sums.append(np.split(back, ends))
        return [packed(*pair) for pair in zip(*sums, strict=True)]

    def run(parts):
        for bucket, rows in _runs(parts, "bucket"):
            block, data = zip(*((r["block"], r["data"]) for r in rows), strict=True)
            yield {"block": list(block), "bucket": [bucket] * len(block), "data": answer(list(data))}

    ordered = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return by_task(ordered, run, "block long, bucket long, data binary")


def _runs(parts: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[dict]]]:
    """Neighbouring rows that are equal in one column."""
    rows: list[dict] = []
    for part in parts:
        for row in part.to_pylist():
            if rows and rows[0][name] != row[name]:
                yield rows[0][name], rows
                rows = []
            rows.append(row)
    if rows:
        yield rows[0][name], rows


def _losses(block: _Block, counts: np.ndarray, totals: tuple[int, int], prior: float) -> np.ndarray:
    """Bits of every distinct pair under both models; ``counts`` has a row of all, one of the target's."""
    size = len(block.hashes)
    found = np.empty_like(counts)
    found[:, block.order] = counts
    single, pair = found[:, :size].astype(float), found[:, size:].astype(float)
    background = single[0] / max(totals[0], 1)
    unigrams = (background, (single[1] + prior * background) / (totals[1] + prior))
    return np.array(
        [
            np.log2(single[k][block.before] + prior) - np.log2(pair[k] + prior * unigrams[k][block.after])
            for k in (0, 1)
        ]
    )


def scores(blocks: DataFrame, answered: DataFrame, totals: tuple[int, int], prior: float = PRIOR) -> DataFrame:
    """doc_id, n_tokens, h_target, h_background, score of every text of every block."""

    def run(parts):
        for _, rows in _runs(parts, "block"):
            block = _Block(rows[0]["data"])
            told = [unpacked(r["data"]) for r in rows[1:]]
            counts = np.array([np.concatenate(c) for c in zip(*told, strict=True)])
            bits = _losses(block, counts, totals, prior)[:, block.place]
            scored = block.word != 0
            text, n_texts = block.text[scored], len(block.ids)
            n = np.bincount(text, minlength=n_texts)
            h_background, h_target = (
                np.bincount(text, weights=b[scored], minlength=n_texts) / np.maximum(n, 1) for b in bits
            )
            yield {
                "doc_id": pa.array(block.ids, pa.int64(), mask=block.there == 0),
                "n_tokens": n,
                "h_target": h_target,
                "h_background": h_background,
                "score": h_target - h_background,
            }

    texts = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), F.col("texts").alias("data"))
    ordered = texts.unionByName(answered).repartition("block").sortWithinPartitions("block", "bucket")
    return by_task(ordered, run, RESULT)


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR
) -> DataFrame:
    """Score every row of ``docs``; ``target_ids`` has the wanted ids in its first column."""
    made = stage(blocks(marked(docs, target_ids, id_col, text_col)), "blocks")
    sums = made.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    bits = max(0, sums[0] // BUCKET_KEYS).bit_length()
    answered = answers(questions(made, bits), 1 << bits)
    return scores(made, answered, (sums[0], sums[1]), prior)
