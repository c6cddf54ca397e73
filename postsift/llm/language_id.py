"""Language ID: a byte convolutional network trained in numpy.

Filters of several widths run over the bytes of a fixed-length window; the largest response of each
filter goes through a rectifier into a softmax. A filter over w bytes is a table lookup per byte, and
two neighbouring bytes are looked up at once. Training takes a bounded sample of labelled windows;
prediction covers every window of a text and adds up the windows' log probabilities by their length.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text of any length is
read whole, in windows; repeated rows get equal results; an empty table gives an empty result; with
no labelled text to learn from every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slice, slices

UNKNOWN = "und"
WINDOW = 256

# The sample that is learnt from: at most so many windows of WINDOW bytes of text. Every label has at
# least one of them, so there may be as many labels; the most frequent ones, if there are more.
MOST_WINDOWS = 6_000


@dataclass(frozen=True)
class Network:
    """``filters[k]`` has a table [width, 256, filters]; ``bias`` and ``out`` join all filters."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows_of(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one padded with zero bytes, and their lengths."""
    n = max(1, -(-len(data) // window))
    padded = np.frombuffer(data.ljust(n * window, b"\0"), dtype=np.uint8).reshape(n, window)
    lengths = np.full(n, window)
    lengths[-1] = len(data) - (n - 1) * window
    return padded, lengths


def learning_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """(language, window) of up to MOST_WINDOWS labelled texts, about as many of each language.

    Texts are chosen by a hash of their id, each gives the window that the hash points to. The first
    text of every label by that hash is always chosen.
    """
    rows = docs.select(
        docs[id_col].cast("string").alias("id"),
        docs[text_col].cast("string").alias("text"),
        docs[lang_col].cast("string").alias("lang"),
        held_out(docs[id_col]).alias("held_out"),
    ).where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_WINDOWS).collect()
    if not counts:
        return []
    share = max(1, (MOST_WINDOWS - len(counts)) // len(counts))
    drawn = [(r["lang"], min(1.0, 1.2 * share / r["count"])) for r in counts]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(drawn, "lang string, wanted double"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    # A quarter of the window's bytes in letters of up to four bytes always fit into it.
    place = 1 + F.pmod(F.xxhash64(F.lit("place"), "id"), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))
    placed = rows.join(wanted, "lang").select(
        "lang",
        F.substring(F.col("text"), place.cast("int"), F.lit(WINDOW)).alias("part"),
        F.xxhash64("id", "text").alias("h"),
        (draw < F.col("wanted")).alias("drawn"),
    )
    first = placed.groupBy("lang").agg(F.min(F.struct("h", "part")).alias("least")).collect()  # a row a label
    sample = {(r["least"]["h"], r["lang"], r["least"]["part"]) for r in first}
    rest = placed.where("drawn").drop("drawn").orderBy("h", "lang", "part").limit(MOST_WINDOWS).collect()
    for r in rest:
        if len(sample) < MOST_WINDOWS:
            sample.add((r["h"], r["lang"], r["part"]))
    return [(lang, part.lower().encode()[:WINDOW]) for _, lang, part in sorted(sample)]


def train(
    sample: list[tuple[str, bytes]],
    widths: tuple[int, ...] = (2, 3, 4),
    each: int = 16,
    epochs: int = 12,
    batch: int = 64,
    rate: float = 0.01,
    seed: int = 7,
) -> Network | None:
    """Fit by Adam on cross entropy; short cuts of the windows are learnt from as well."""
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(seed)
    x = np.vstack([windows_of(data)[0][:1] for _, data in sample])
    y = np.array([languages.index(lang) for lang, _ in sample])
    # The same texts cut short, so that a few words are enough to tell.
    cut = x.copy()
    keep = rng.integers(8, 64, len(cut))
    cut[np.arange(WINDOW) >= keep[:, None]] = 0
    x, y = np.vstack([x, cut]), np.concatenate([y, y])
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    total = each * len(widths)
    params = [rng.normal(0, 0.3, (w, 256, each)).astype(np.float32) for w in widths]
    for table in params:
        table[:, 0] = 0
    params += [
        np.zeros(total, np.float32),
        rng.normal(0, 0.2, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    ]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            grads = _gradients(params, x[own], y[own], weight[y[own]], each)
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    k = len(widths)
    return Network(languages, params[:k], params[k], params[k + 1], params[k + 2])


def _pooled(tables: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    tops, places = [], []
    for table in tables:
        width = len(table)
        n = x.shape[1] - width + 1
        response = table[0][x[:, :n]]
        for j in range(1, width):
            response += table[j][x[:, j : j + n]]
        place = response.argmax(axis=1)
        places.append(place)
        tops.append(np.take_along_axis(response, place[:, None], axis=1)[:, 0])
    return np.concatenate(tops, axis=1), places


def _gradients(params, x, y, weight, each: int):
    *tables, bias, out, out_bias = params
    top, places = _pooled(tables, x)
    hidden = np.maximum(top + bias, 0)
    logits = hidden @ out + out_bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (weight / len(y))[:, None]
    back = (p @ out.T) * (hidden > 0)
    grads = []
    rows = np.arange(len(y))[:, None]
    for k, (table, place) in enumerate(zip(tables, places, strict=True)):
        g = np.zeros_like(table)
        own = back[:, k * each : (k + 1) * each]
        for j in range(len(table)):
            np.add.at(g[j], (x[rows, place + j], np.arange(each)[None, :]), own)
        g[:, 0] = 0  # padding stays silent
        grads.append(g)
    return [*grads, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Predictor:
    """A network with the tables of neighbouring bytes added up in pairs."""

    def __init__(self, network: Network):
        self.network = network
        self.pairs = []
        for table in network.filters:
            double = [
                (table[j][:, None] + table[j + 1][None, :]).reshape(65536, -1) for j in range(0, len(table) - 1, 2)
            ]
            self.pairs.append((double, table[-1] if len(table) % 2 else None, len(table)))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        tops = []
        for double, single, width in self.pairs:
            n = x.shape[1] - width + 1
            response = np.take(double[0], pair[:, :n], axis=0)
            for k, table in enumerate(double[1:], 1):
                response += np.take(table, pair[:, 2 * k : 2 * k + n], axis=0)
            if single is not None:
                response += np.take(single, x[:, width - 1 : width - 1 + n], axis=0)
            tops.append(response.max(axis=1))
        logits = np.maximum(np.concatenate(tops, axis=1) + self.network.bias, 0) @ self.network.out
        logits += self.network.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None], step: int = 256) -> list[tuple[str, float]]:
        """(language, score) of each text; ``step`` windows go through the network together."""
        counted = [i for i, t in enumerate(texts) if _has_letter(t)]
        parts = [windows_of(texts[i].lower().encode()) for i in counted]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not parts:
            return out
        x = np.vstack([w for w, _ in parts])
        lengths = np.concatenate([n for _, n in parts])
        logs = np.vstack([self.log_probabilities(x[i : i + step]) for i in range(0, len(x), step)])
        starts = np.concatenate([[0], np.cumsum([len(w) for w, _ in parts])[:-1]])
        sums = np.add.reduceat(logs * lengths[:, None], starts) / WINDOW
        sums -= sums.max(axis=1, keepdims=True)
        p = np.exp(sums)
        p /= p.sum(axis=1, keepdims=True)
        for i, row in zip(counted, p, strict=True):
            best = int(row.argmax())
            out[i] = (self.network.languages[best], float(row[best]))
        return out


def languages(
    docs: DataFrame,
    network: Network | None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (probability)."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        held_out(docs[id_col]).alias("held_out"),
        docs[text_col].cast("string").alias("text"),
    )

    def run(part: pa.RecordBatch):
        texts = part.column("text").to_pylist()
        found = Predictor(network).predict(texts) if network else [(UNKNOWN, 0.0)] * len(texts)
        return {
            "doc_id": part.column("doc_id"),
            "held_out": part.column("held_out"),
            "lang_pred": [f[0] for f in found],
            "score": [f[1] for f in found],
        }

    return by_slice(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    return train(learning_sample(docs, id_col, text_col, lang_col))


def with_language(
    docs: DataFrame,
    network: Network | None,
    least_score: float = 0.0,
    text_col: str = "text",
    lang_col: str | None = None,
) -> DataFrame:
    """``docs`` without the rows that have no letter, or whose language is scored below ``least_score``.

    Rows that have no label in ``lang_col`` get the predicted language. Without a network there are no
    scores, every row with a letter stays, and labels stay as they are.
    """
    at = docs.columns.index(text_col)
    label_at = None if lang_col is None else docs.columns.index(lang_col)

    def run(batches):
        predictor = Predictor(network) if network else None
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            if predictor:
                found = predictor.predict(texts)
                keep = [lang != UNKNOWN and p >= least_score for lang, p in found]
                if label_at is not None:
                    old = batch.column(label_at)
                    labels = [p if has is None else has for has, (p, _) in zip(old.to_pylist(), found, strict=True)]
                    batch = batch.set_column(label_at, batch.schema.field(label_at), pa.array(labels, old.type))
            else:
                keep = [_has_letter(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
