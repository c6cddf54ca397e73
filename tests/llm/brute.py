"""Plain Python versions of the operators, over a list of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re

import xxhash

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def folded(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def substring(rows, width=13):
    words = {i: BLANK.findall((t or "").encode()) for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][s : s + width]), i)
    out = []
    for i, ws in words.items():
        gone = [False] * len(ws)
        for s in range(len(ws) - width + 1):
            if first[tuple(ws[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode()
        out.append((i, len(ws), sum(gone), sha(kept)))
    return sorted(out)


def simhash(rows, most=4):
    prints = {}
    for i, t in rows:
        words = BLANK.findall(folded(t or "").encode())
        shingles = [b" ".join(words[s : s + 4]) for s in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids, root = sorted(prints), {}

    def top(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((i, f"{prints[i]:016x}", top(i)) for i in ids)


def syncmers(data: bytes, k: int, s: int, hash_of) -> list[tuple[int, int]]:
    """(hash, offset) of closed syncmers; ``hash_of(bytes)`` gives an integer."""
    if not data:
        return []
    out = []
    for i in range(len(data) - k + 1):
        inner = [hash_of(data[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((hash_of(data[i : i + k]), i))
    return out or [(hash_of(data), 0)]


def chain_likeness(a: list[int], b: list[int]) -> float:
    """Dice share of the longest chain of equal anchors, the n-th of a kind matched with the n-th."""
    if not a or not b:
        return float(len(a) == len(b))

    def numbered(hashes):
        return [(h, hashes[:i].count(h)) for i, h in enumerate(hashes)]

    at = {h: i for i, h in enumerate(numbered(b))}
    places = [at[h] for h in numbered(a) if h in at]
    longest = [0] * len(places)
    for i, p in enumerate(places):
        longest[i] = 1 + max((longest[j] for j in range(i) if places[j] < p), default=0)
    return 2 * max(longest, default=0) / (len(a) + len(b))


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]
