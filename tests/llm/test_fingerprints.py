"""Fingerprints against a plain version that looks at every k-mer by itself."""

from __future__ import annotations

import brute
import numpy as np

from postsift.llm import syncmers


def hash_of(data: bytes) -> int:
    """The operator's hash of a run of bytes, in plain integers."""
    mask, out = (1 << 64) - 1, 0
    for byte in data:
        out = (out * int(syncmers._BASE) + int(syncmers._BYTE[byte])) & mask
    out = ((out ^ (out >> 31)) * 0x7FB5D329728EA185) & mask
    return out ^ (out >> 29)


def plain(text: str) -> list[int]:
    found = brute.syncmers(text.encode(), syncmers.K, syncmers.S, hash_of)
    return [h >> 32 for h, _ in found]


def texts():
    rng = np.random.default_rng(9)
    words = ["lorem", "ipsum", "ünd", "dolor", "sit", "😀", "a", "amet\n", "amet\n"]
    made = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 3, 5, 8, 20, 40, 60)]
    return [*made, "x" * 50, "same line\n" * 12, "same line\n" * 3]


def test_query_equals_the_plain_version(spark):
    rows = [*enumerate(texts()), (40, None)]
    out = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        new = brute.edited(text, after)
        own = syncmers.of_text(out[i].fingerprint)
        found = brute.syncmers(text.encode(), syncmers.K, syncmers.S, hash_of)
        assert [*zip(own[0].tolist(), own[1].tolist())] == [(h >> 32, at) for h, at in found]
        assert syncmers.of_text(out[i].edited_fingerprint)[0].tolist() == plain(new)
        assert out[i].edited_sha256 == brute.sha(new) and out[i].n_chars == len(text)
        assert abs(out[i].near_edited - brute.chain_likeness(plain(text), plain(new))) < 1e-12
        assert abs(out[i].near_next - brute.chain_likeness(plain(text), plain(after))) < 1e-12


def test_one_more_byte_changes_little():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 400, dtype=np.uint8).tobytes()
    for n in range(60, 399):
        a, b = syncmers.fingerprint(text[:n]), syncmers.fingerprint(text[: n + 1])
        assert syncmers.likeness(a, b) > 0.9, n


def test_repeats_count():
    rng = np.random.default_rng(3)
    passage = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(100)).encode()
    one, ten = syncmers.fingerprint(passage), syncmers.fingerprint(passage * 10)
    assert abs(syncmers.likeness(one, ten) - 2 / 11) < 0.01 and syncmers.likeness(ten, ten) == 1
