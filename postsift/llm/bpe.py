"""BPE encoding and decoding with a public vocabulary, as the tokenizers library does it.

Encoding: special tokens are cut out of the raw text; the rest is brought to NFC and lower case and
split into words; a word's bytes are symbols in a doubly linked list, and a priority queue of merge
ranks takes the lowest rank first, skipping entries whose symbols have changed since. The queue is
worked for many distinct words at once: words are independent, so all entries of one rank are merged
together, and numpy does the linking. Decoding joins vocabulary strings.

Words repeat, so the ids of a white-space separated chunk are kept for the task, up to
``CACHE_CHUNKS`` of them; then the store is emptied. That bounds memory and changes no result.

Defined cases: null and empty texts have no ids and decode to the empty string; a text of any length
is encoded whole; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import by_task, id_and_text

CACHE_CHUNKS = 400_000

# Fixed pattern of the word vocabulary; white space as Unicode has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else 256, 257, ..."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """``keys`` are left * size + right of the merges, ascending, with their ranks and results."""

    strings: list[str]
    inner: np.ndarray
    final: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    specials: dict[str, int]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizers file: byte-level BPE whose words end in ``end_of_word_suffix``."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ids = model["vocab"]
    suffix = model["end_of_word_suffix"] or ""
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [""] * (1 + max([*ids.values(), *specials.values()]))
    for token, i in [*ids.items(), *specials.items()]:
        strings[i] = token
    made: set[int] = set()
    left, right, merged = [], [], []
    for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        left.append(ids[a])
        right.append(ids[b])
        merged.append(ids[a + b])
        made.add(ids[a + b])
    # All entries of a rank are merged together, which is right if no merge needs a later one.
    known = set(ids.values()) - made
    for a, b, c in zip(left, right, merged, strict=True):
        if a not in known or b not in known:
            raise ValueError("a merge uses a symbol that a later merge makes")
        known.add(c)
    keys = np.array(left, dtype=np.int64) * len(strings) + np.array(right)
    order = np.argsort(keys)
    symbols = byte_symbols()
    return Vocabulary(
        strings,
        np.array([ids[s] for s in symbols], dtype=np.int64),
        np.array([ids[s + suffix] for s in symbols], dtype=np.int64),
        keys[order],
        order.astype(np.int64),
        np.array(merged, dtype=np.int64)[order],
        specials,
    )


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers; words are not empty."""
    if not words:
        return []
    size, v = len(vocabulary.strings), vocabulary
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    symbol = v.inner[data]
    symbol[ends - 1] = v.final[data[ends - 1]]
    following = np.arange(1, len(data) + 1)
    following[ends - 1] = -1
    before = np.arange(-1, len(data) - 1)
    before[0] = -1
    before[ends[:-1]] = -1
    alive = np.ones(len(data), dtype=bool)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def push(at: np.ndarray) -> None:
        pair = symbol[at] * size + symbol[following[at]]
        place = np.minimum(np.searchsorted(v.keys, pair), len(v.keys) - 1)
        there = v.keys[place] == pair
        at, place = at[there], place[there]
        order = np.argsort(place, kind="stable")
        at, place = at[order], place[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        firsts = place[np.concatenate([[0], cuts])] if len(place) else place
        for p, group in zip(firsts.tolist(), np.split(at, cuts), strict=False):
            rank = int(v.ranks[p])
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(queue, rank)
                place_of[rank] = p
            waiting[rank].append(group)

    place_of: dict[int, int] = {}
    push(np.flatnonzero(following >= 0))
    while queue:
        rank = heapq.heappop(queue)
        groups, p = waiting.pop(rank), place_of[rank]
        at = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
        a, b = divmod(int(v.keys[p]), size)
        at = at[alive[at] & (symbol[at] == a)]
        at = at[following[at] >= 0]
        at = at[symbol[following[at]] == b]
        if a == b:  # in a run of equal symbols the leftmost pairs win
            taken, last = [], -1
            for i in np.sort(at).tolist():
                if i != last:
                    taken.append(i)
                    last = int(following[i])
            at = np.array(taken, dtype=np.int64)
        if not len(at):
            continue
        gone = following[at]
        symbol[at] = v.merged[p]
        alive[gone] = False
        after = following[gone]
        following[at] = after
        more = after >= 0
        before[after[more]] = at[more]
        ahead = before[at]
        push(np.unique(np.concatenate([ahead[ahead >= 0], at[more]])))
    kept = np.concatenate([[0], np.cumsum(alive)])
    out = symbol[alive].astype("<u4").tobytes()
    stops = (kept[ends] * 4).tolist()
    return [out[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]


class Encoder:
    """Encodes and decodes texts; lives as long as its task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS)
        self.special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in vocabulary.specials) + ")")
            if vocabulary.specials
            else None
        )
        self.strings = np.array(vocabulary.strings, dtype=object)
        self.chunks: dict[str, bytes] = {}

    def split(self, text: str) -> list[list[str] | bytes]:
        """Chunks between spaces or line ends, or the id of a special token."""
        out: list[list[str] | bytes] = []
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.vocabulary.specials[part].to_bytes(4, "little"))
            elif part:
                # Lower case letter by letter: a capital sigma never becomes a final one.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.append(part.replace("\n", " ").split(" "))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks = {}
        new = {c for parts in split for part in parts if isinstance(part, list) for c in part}
        self.learn(list(new.difference(self.chunks)))
        known = self.chunks.__getitem__
        return [
            b"".join(b"".join(map(known, part)) if isinstance(part, list) else part for part in parts)
            for parts in split
        ]

    def learn(self, chunks: list[str]) -> None:
        words = [[w.encode() for w in self.words.findall(c)] for c in chunks]
        distinct = list({w for ws in words for w in ws})
        ids = dict(zip(distinct, encode_words(distinct, self.vocabulary), strict=True))
        for chunk, ws in zip(chunks, words, strict=True):
            self.chunks[chunk] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings one after the other, with a space between them."""
        return " ".join(self.strings[np.frombuffer(ids, dtype="<u4")].tolist())


def encoded(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (bytes) and decoded."""
    return _coded(docs, vocabulary_path, id_col, text_col, lambda ids, text: (ids, text), "ids binary, decoded string")


def encoded_digests(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Like ``encoded``, with SHA-256 digests instead of ids and decoded text."""

    def digests(ids: bytes, text: str) -> tuple[str, str]:
        from hashlib import sha256

        return sha256(ids).hexdigest(), sha256(text.encode()).hexdigest()

    return _coded(docs, vocabulary_path, id_col, text_col, digests, "ids_sha256 string, decoded_sha256 string")


def _coded(docs, vocabulary_path, id_col, text_col, shape, columns) -> DataFrame:
    vocabulary = load_vocabulary(vocabulary_path)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(parts):
        coder = Encoder(vocabulary)
        for part in parts:
            coded = coder.encode(part.column("text").to_pylist())
            shaped = [shape(ids, coder.decode(ids)) for ids in coded]
            yield {
                "doc_id": part.column("doc_id"),
                "n_tokens": [len(ids) // 4 for ids in coded],
                names[0]: [s[0] for s in shaped],
                names[1]: [s[1] for s in shaped],
            }

    return by_task(
        id_and_text(docs, id_col, text_col), run, f"doc_id long, n_tokens long, {columns}"
    )
