"""Phrases, token counts and clusters against plain Python, the library and SQL."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from postsift.llm import clustering, collocations, token_counts

sentencepiece = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")
SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, phrase int, n int, key string, shard string"


@pytest.mark.parametrize("name", ["op11_collocations", "op13_clustering"])
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name], connect(SF_DIR)) is None


def phrases_by_hand(rows, support, top, share=80):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.folded(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update(
                (lang or "und", *words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1)
            )
    out = []
    often = {p: a for p, a in f.items() if a >= support and len(p) > 2}
    for p, a in often.items():
        words = " ".join(p[1:])
        longer = [
            b for q, b in often.items()
            if q[0] == p[0] and len(q) > len(p) and f" {words} " in f" {' '.join(q[1:])} "
        ]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[p[:k]] + f[p[0], *p[k:]]), k) for k in range(2, len(p))]
        score, k = min(cuts)
        out.append((p[0], -score, -a, words.encode(), f[p[:k]], f[p[0], *p[k:]], n[p[0]]))
    ranked, at = [], Counter()
    for lang, score, a, words, l, r, total in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], words.decode(), -a, l, r, total, -score))
    return ranked


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("shards", "segment"), [(1, 1 << 20), (3, 1 << 20), (5, 50)])
def test_phrases_equal_counts_by_hand(spark, shards, segment):
    rng = np.random.default_rng(3)
    words = np.array(["New", "york", "city", "é", "EÉ", "a", "the", "of", "x y", "<s>", "日本"])
    ends = np.array([" ", "  ", "\t", ". ", ",", "\n", " ; ", "\r\n"])
    rows = [(1, None, "en"), (2, "", None), (3, " ,. \t", "en"), (None, "new york city " * 9, None)]
    for i in range(40):
        picked = rng.choice(words, 30, p=np.arange(11, 0, -1) / 66)
        gaps = rng.choice(ends, 30, p=[0.6, 0.1, 0.1, 0.04, 0.04, 0.04, 0.04, 0.04])
        rows.append((i // 2, "".join(w + g for w, g in zip(picked, gaps, strict=True)), ["en", None, "und", "de"][i % 4]))
    rows += rows[-3:]
    docs = spark.createDataFrame([(*r, 1, 2, "k", "s") for r in rows], DOCS)
    for support, top in ((7, 1000), (7, 5), (12, 1000)):
        got = collocations.collocations(docs, support=support, top=top, shards=shards, segment=segment)
        assert got.columns == list(COLUMNS)
        want = phrases_by_hand(rows, support, top)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 5


def test_phrases_of_one_hot_language_and_long_texts(spark):
    """Two thirds of the words in one text of one language, cut between pieces into many segments."""
    long = "to be or not to be, that is; " * 4000
    rows = [(1, long, "en"), (2, "to be or not to be", "en"), (3, "to be " * 29 + "to be", "fr")]
    docs = spark.createDataFrame([(*r, 1, 2, "k", "s") for r in rows], DOCS)
    got = collocations.collocations(docs, segment=1 << 10)
    assert sorted(tuple(r) for r in got.collect()) == sorted(phrases_by_hand(rows, 30, 2000))


def test_full_bit_tables_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(tuple(r) for r in collocations.collocations(docs, support=9).collect())
    bits_of = collocations.bits_of
    monkeypatch.setattr(collocations, "bits_of", lambda keys: np.maximum(bits_of(keys), 255))
    assert sorted(tuple(r) for r in collocations.collocations(docs, support=9).collect()) == want and want


def test_no_documents_no_phrases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations.collocations(empty).collect() == []
    rare = spark.createDataFrame([(1, "one two three", "en", 1, 2, "k", "s")], DOCS)
    assert collocations.collocations(rare).collect() == []


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))


def odd_texts():
    rng = np.random.default_rng(5)
    signs = ["a", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "é", "日", "ﬁ", "😀", "1", "20", "<s>", "</s>", "<unk>", "\x00", "　"]
    return ["", " ", "\n", "a" * 300, "▁▁ ▁"] + ["".join(rng.choice(signs, rng.integers(1, 90))) for _ in range(400)]


@pytest.mark.parametrize("long", [1, 2, 7, 40, 1 << 15])
def test_split_texts_count_as_whole_ones(model, long):
    pieces = token_counts.Pieces(vocabularies.path("piece_bpe_32k.model"))
    texts = odd_texts()
    assert all("".join(pieces.parts(t, long)) == t for t in texts)
    assert pieces.counts(texts, long, call_bytes=200) == [len(model.encode(t)) for t in texts]


def test_long_texts_are_split_and_calls_bounded():
    pieces = token_counts.Pieces(vocabularies.path("piece_bpe_32k.model"))
    parts = pieces.parts("some words of a long text, " * 1000, 500)
    assert len(parts) > 40 and max(map(len, parts)) < 540
    assert pieces.parts("=" * 5000, 500) == ["=" * 5000]  # no safe boundary: whole
    calls = list(token_counts._calls(pieces._owned(["some words " * 1000, "x", "y" * 9], 500), 1200))
    assert max(sum(len(p.encode()) for _, p, _ in c) for c in calls) <= 1200 and len(calls) > 9


def test_token_counts_equal_the_library(spark, model):
    path = vocabularies.path("piece_bpe_32k.model")
    out = entry.queries()["op12_token_counts"](spark, SF_DIR).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    rows = [(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, "lang " * 9000)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, path, limit=3, long=100).collect())
    counts = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    assert got == Counter((*c, c[2] > 3) for c in counts)
    assert token_counts.token_counts(docs.limit(0), path).collect() == []


def clusters_by_hand(rows, dims, k, rounds, seed="2:"):
    kept = [
        (i, [math.floor(256 * x) if abs(x) < 2**60 else int(x) * 256 for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"{seed}{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else c for c, o in zip(centroids, own, strict=True)]
    got = [(i, *near(v)) for i, v in kept]

    def fits(ds):
        return sum(ds) if all(d < 2**63 for d in ds) and sum(ds) < 2**63 else None

    return [
        (i, j, fits([d]), fits([e for _, e, c in got if c == j]), fits([e for _, e, _ in got]),
         hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for i, d, j in got
    ]


VECTORS = "vec_id long, embedding array<double>, cluster string, point int"


def as_rows(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("pivots", [1, 2, 5, 16])
def test_clusters_equal_plain_rounds(spark, pivots):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(150)]  # a third the same
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [math.nan] * 8), (905, [math.inf] * 8)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = clustering.clusters(frame, dims=8, k=12, rounds=4, pivots=pivots).collect()
    assert as_rows(got) == as_rows(clusters_by_hand(rows, 8, 12, 4)) and len(got) == 453


@pytest.mark.parametrize("huge", [2.0**19 + 0.5, 1e30, 1.5e308])
def test_clusters_of_huge_components(spark, huge):
    rows = [(i, [float(i % 5), i / 7, -float(i)]) for i in range(40)] + [(50, [huge, 0.0, -huge]), (51, [huge, 1.0, -huge])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    for k in (3, 60):
        got = clustering.clusters(frame, dims=3, k=k, rounds=3).collect()
        assert as_rows(got) == as_rows(clusters_by_hand(rows, 3, k, 3))


def test_clusters_of_little(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert clustering.clusters(frame).collect() == []
    same = spark.createDataFrame([(i, [0.5, -0.25], "x", 1) for i in range(5)], VECTORS)
    got = clustering.clusters(same, dims=2, k=3).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 5


def test_bounds_hold_and_filter(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("embedding").toPandas().embedding
    points = np.floor(256 * np.stack(vectors).astype(float)).astype(np.int64)
    centres = points[:40]
    base = clustering.Simplex.over(centres)
    true = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    flat, height, first = base.apexes(base.reach(points))
    of_c = base.apexes(base.reach(centres))
    gap = ((flat[:, None] - of_c[0]) ** 2).sum(axis=2)
    assert (gap + (height[:, None] - of_c[1]) ** 2 <= true + 1e-3).all()
    assert (gap + (height[:, None] + of_c[1]) ** 2 >= true - 1e-3).all()
    left = base.may_be_nearest(base.reach(points), base.reach(centres))
    assert left[np.arange(len(points)), true.argmin(axis=1)].all()
    assert len(base.pivots) == clustering.PIVOTS and left.mean() < 0.8


def test_sums_beyond_64_bits():
    for value in (0, 1, -1, (1 << 40) - 1, -(1 << 90) + 5):
        assert sum(part << (clustering.LIMB * place) for place, part in clustering._limbs(value).items()) == value


def test_scores_are_exact_where_products_pass_64_bits(spark):
    a, l, r = (1 << 62) + 3, (1 << 62) + 9, (1 << 62) + 4
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", l), ("en", "y", r), ("en", None, l)], "lang string, phrase string, n long")
    (row,) = collocations.scored(counts).select("score", F.col("a")).collect()
    assert row.score == 2_000_000 * a // (l + r)
