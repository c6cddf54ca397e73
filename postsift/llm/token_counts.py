"""Token counts: batches of about equal bytes are encoded in Arrow functions that return lengths only.

A task hands its texts to the tokenizer in calls of at most ``CALL_BYTES``. A text longer than
``LONG`` code points is split at safe boundaries and its parts are counted apart: a boundary is safe
if no entry of the vocabulary holds the two characters beside it next to each other, so that no token
can lie across it. Parts after the first are encoded behind a guard character that stands in no entry
of the vocabulary, because the tokenizer marks the start of its input; the guard's own tokens are
taken off again. A long text without a safe boundary is encoded whole, so counts never differ from
the library's.

Defined cases: null counts as empty; an empty text has no tokens; strings of special tokens inside a
text are ordinary text, as is the library's default; every row keeps its own count, rows that repeat
an id included; columns other than id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_task, id_and_text

# Bytes of one call of the tokenizer (one longer part excepted), and code points of an unsplit text.
CALL_BYTES = 1 << 20
LONG = 1 << 15

MARK = "▁"  # how the vocabulary writes a space


class Pieces:
    """A sentencepiece model with the character pairs that may stand inside a token."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        entries = [
            self.model.id_to_piece(i)
            for i in range(self.model.get_piece_size())
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        ]
        self.inside = {entry[i : i + 2] for entry in entries for i in range(len(entry) - 1)}
        known = {c for entry in entries for c in entry}
        guards = [c for c in "\n\r\x01\x02\x03" if c not in known]
        # Splitting is sound only where the model reads characters as they stand.
        probe = "ﬁ  ①é "
        as_is = self.model.decode(self.model.encode(probe)) == probe
        self.guard = guards[0] if guards and as_is else None
        self.guard_tokens = len(self.model.encode(self.guard)) if self.guard else 0

    def safe(self, text: str, at: int) -> bool:
        """Whether no token can hold the characters before and after ``at``."""
        return text[at - 1 : at + 1].replace(" ", MARK) not in self.inside

    def parts(self, text: str, long: int = LONG) -> list[str]:
        """``text`` cut at the first safe boundary after every ``long`` code points."""
        if self.guard is None or len(text) <= long:
            return [text]
        out, start = [], 0
        while len(text) - start > long:
            at = start + long
            while at < len(text) and not self.safe(text, at):
                at += 1
            out.append(text[start:at])
            start = at
        if start < len(text):
            out.append(text[start:])
        return out

    def counts(self, texts: list[str], long: int = LONG, call_bytes: int = CALL_BYTES) -> list[int]:
        totals = [0] * len(texts)
        for call in _calls(self._owned(texts, long), call_bytes):
            encoded = self.model.encode([part for _, part, _ in call], num_threads=1)
            for (row, _, off), ids in zip(call, encoded, strict=True):
                totals[row] += len(ids) - off
        return totals

    def _owned(self, texts: list[str], long: int) -> Iterator[tuple[int, str, int]]:
        """Every part with the row it belongs to and the tokens to take off."""
        for row, text in enumerate(texts):
            for i, part in enumerate(self.parts(text, long)):
                yield (row, self.guard + part, self.guard_tokens) if i else (row, part, 0)


def _calls(parts: Iterator[tuple[int, str, int]], call_bytes: int) -> Iterator[list[tuple[int, str, int]]]:
    """Runs of parts of about ``call_bytes`` each."""
    call: list[tuple[int, str, int]] = []
    size = 0
    for part in parts:
        n = len(part[1].encode())
        if call and size + n > call_bytes:
            yield call
            call, size = [], 0
        call.append(part)
        size += n
    if call:
        yield call


def token_counts(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    long: int = LONG,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens and whether they exceed ``limit``.

    ``model_path`` names a sentencepiece model that executors can open.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        pieces = Pieces(model_path)
        for part in parts:
            texts = part.column("text").to_pylist()
            yield {
                "doc_id": part.column("doc_id"),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": pieces.counts(texts, long, call_bytes),
            }

    counted = by_task(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
