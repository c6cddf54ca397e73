"""Training-data operators against plain Python and the libraries they have to agree with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from postsift.llm import (
    bpe,
    exact_dedup,
    language_id,
    lm_scoring,
    packing,
    secret_scan,
    simhash,
    substring_dedup,
    syncmers,
    warc_archive,
)
from postsift.llm.components import components
from postsift.session import stage

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
SF_DIR = "/root/testdata/sf0.001"

# Nulls, empty and long texts, equal texts, repeated rows, odd letters; columns whose names clash.
PASSAGE = " ".join(f"wort{i}" for i in range(40))
ROWS = [
    (1, "Ein Satz, der so nur hier steht: password = hunter22x", "de", 7),
    (2, None, None, 7),
    (3, "", "en", 7),
    (4, "SAME text Éé", "en", 7),
    (5, "same TEXT Éé", "en", None),
    (6, "vorn " + PASSAGE + " hinten", "de", 7),
    (7, "anders " + PASSAGE, "de", 7),
    (7, "anders " + PASSAGE, "de", 7),
    (8, "a " * 30_000 + "AKIA" + "B2" * 9 + " ünd " + "0f" * 13, "de", 7),
    (9, "  \t\n <|endoftext|>x  y　z 😀 <|startoftext|>", "en", 7),
    (10, "kurz", None, 7),
]
SCHEMA = "doc_id long, text string, lang string, {}"


@pytest.fixture(params=["bits", "text_sha256"])
def docs(spark, request):
    return spark.createDataFrame(ROWS, SCHEMA.format(f"{request.param} int"))


@pytest.fixture
def plain(spark):
    return spark.createDataFrame(ROWS, SCHEMA.format("n_chars int"))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA.format("n_chars int"))


def texts():
    return [(i, t or "") for i, t, *_ in ROWS]


def documents(spark):
    return sorted(tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op10_warc_archive"])
def test_query_equals_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name], connect(SF_DIR)) is None


def test_exact_groups(docs):
    out = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs, filter_bits=1 << 10).collect()}
    for i, t in texts():
        same = [j for j, u in texts() if brute.folded(u) == brute.folded(t)]
        r = out[i, brute.sha(brute.folded(t))]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))


@pytest.mark.parametrize("bits", [8, 1 << 20])
def test_drop_copies(docs, bits):
    kept = exact_dedup.drop_copies(docs, filter_bits=bits)
    assert kept.columns == docs.columns
    assert found(kept, "doc_id") == [(i,) for i in (1, 3, 5, 6, 7, 8, 9, 10)]


def test_secrets_equal_regexes(spark):
    assign = re.compile(
        rb"""((?:%s))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        % b"|".join(
            b"".join(b"[%c%c]" % (c, c - 32) if 97 <= c <= 122 else b"_?" for c in w)
            for w in (b"password", b"passwd", b"secret", b"token", b"api_key")
        )
    )
    others = {1: (re.compile(rb"AKIA[A-Z0-9]+"), 20), 2: (re.compile(rb"[0-9a-f]+"), 24)}
    machine = secret_scan.compile_rules()
    heads = secret_scan._head_patterns(machine.rules)
    rng = np.random.default_rng(3)
    parts = ["password", "PassWD", "token", "apikey", "AKIA", "=", ":", " ", '"', "x1", "deadbeef" * 3, "ABCD" * 5, "é", "\n", "a"]
    for _ in range(3000):
        data = "".join(rng.choice(parts, rng.integers(0, 12))).encode()
        want = [(m.start(), 0, m.end()) for m in assign.finditer(data) if len(m[2]) >= 6]
        want += [(m.start(), k, m.end()) for k, (p, n) in others.items() for m in p.finditer(data) if m.end() - m.start() >= n]
        assert secret_scan.find_secrets(data, machine, heads) == sorted(want), data


def test_secret_spans_and_masks(docs):
    spans = {r.doc_id: [tuple(s) for s in r.secrets] for r in secret_scan.secret_spans(docs).collect()}
    text = dict(texts())[8]
    assert spans[1] == [("assign", 33, 53)] and spans[2] == []
    assert [text[a:b] for _, a, b in spans[8]] == ["AKIA" + "B2" * 9, "0f" * 13]
    masked = {r.doc_id: r.text for r in secret_scan.masked(docs).collect()}
    assert masked[1].endswith("hier steht: [assign]") and masked[2] is None and masked[8].endswith("[access] ünd [hex]")


def test_rules_that_need_a_second_look_are_refused():
    for regex in ("a(bb)*", "ab|a", "x*"):
        with pytest.raises(ValueError):
            secret_scan.compile_rules((secret_scan.Rule("odd", regex),))


def test_language_is_learnt(spark):
    out = entry.queries()["op4_language_id"](spark, "/root/testdata/sf0.01")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(known, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(docs, empty):
    network = language_id.trained(docs)
    out = language_id.languages(docs, network).collect()
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {2, 3}
    assert all(0 <= r.score <= 1 for r in out)
    assert found(language_id.with_language(docs, network), "doc_id") == [(i,) for i in (1, 4, 5, 6, 7, 7, 8, 9, 10)]
    assert language_id.trained(empty) is None
    assert {r.lang_pred for r in language_id.languages(docs, None).collect()} == {"und"}


def test_unlabelled_documents_stay(spark, plain):
    import corpus_pipeline as pipeline

    bare = plain.withColumn("lang", F.lit(None).cast("string"))
    kept = pipeline.in_known_language(spark, bare, SF_DIR)
    assert kept.columns == bare.columns
    assert found(kept, "doc_id") == [(i,) for i in (1, 4, 5, 6, 7, 7, 8, 9, 10)]


def test_substrings_equal_brute_force(spark, docs):
    query = entry.queries()["op5_substring_dedup"](spark, SF_DIR)
    assert found(query, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(documents(spark))
    out = found(substring_dedup.without_repeats(docs, digest=True), "doc_id", "n_words", "n_removed", "kept")
    assert sorted(set(out)) == brute.substring(texts()) and len(out) == len(ROWS)
    row = substring_dedup.without_repeats(docs).where("doc_id = 7").first()
    assert row.kept == "anders" and [tuple(f) for f in row.factors] == [(1, 40, 6, 1)]


def test_factors_are_runs_of_their_documents(spark):
    words = [f"w{i}" for i in range(1, 60)]
    split = " ".join([*words[:13], "zwischen", *words[1:14]])
    texts = {
        1: split,
        2: " ".join(words[:14]),
        3: " ".join(["vor", *words[20:50], "nach"]),
        4: " ".join([*words[15:55], *words[20:40]]),
        5: " ".join(words[25:45] + words[2:20] + words[20:50]),
        6: "x " * 40,
        7: "y " + "x " * 60,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect()}
    # No document holds the 14 words of the second as they are, but every one goes.
    assert [tuple(f) for f in out[2].factors] == [(0, 13, 1, 0), (1, 13, 1, 14)] and out[2].kept == ""
    assert [tuple(f) for f in out[4].factors][0] == (5, 30, 3, 1)
    for doc_id, row in out.items():
        own = texts[doc_id].split()
        for f in row.factors:
            assert f.doc_id < doc_id and f.words >= 13
            assert own[f.start : f.start + f.words] == texts[f.doc_id].split()[f.at : f.at + f.words]
        under = {i for f in row.factors for i in range(f.start, f.start + f.words)}
        assert row.n_removed == len(under) and row.kept.split() == [w for i, w in enumerate(own) if i not in under]
    brief = substring_dedup.without_repeats(docs, digest=True)
    assert found(brief, "doc_id", "n_words", "n_removed", "kept") == brute.substring(list(texts.items()))


def test_simhash_equals_brute_force(spark, docs):
    query = entry.queries()["op7_simhash"](spark, SF_DIR)
    assert found(query, "doc_id", "fingerprint", "component_id") == brute.simhash(documents(spark))
    out = simhash.near_groups(docs).select("doc_id", simhash.hex_of(F.col("bits")).alias("f"), "component_id")
    assert sorted(set(found(out, *out.columns))) == brute.simhash(texts())
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for *_, c in brute.simhash(texts())}


def test_hot_buckets_are_dealt_further(spark):
    rng = np.random.default_rng(5)
    flips = (rng.random((400, 64)) < 0.04).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    values = np.unique(np.uint64(0xABCDEF0123456789) ^ flips.sum(axis=1).astype(np.uint64))
    frame = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "bits long")
    assert found(simhash.linked(frame, most=200), "node", "root") == found(simhash.linked(frame), "node", "root")


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert found(components(edges), "node", "root") == [(i, 0) for i in range(1, 61)] + [(101, 100)]


def test_fingerprints_and_neighbours(docs):
    out = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    rows = sorted(texts(), key=lambda r: r[0])
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        if i == 7:  # a repeated row: its two copies follow each other
            continue
        new = syncmers.edited(text, after)
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == brute.sha(new)
        assert out[i].fingerprint == syncmers.text_of(syncmers.fingerprint(text.encode()))
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    assert out[3].fingerprint == ""


NO_ID = syncmers.NO_ID


def test_blocks_of_neighbours_are_alike_however_ids_lie(spark):
    ids = [None, -(1 << 62), *range(2000), 1 << 40, 1 << 62]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    placed = syncmers.neighbours(docs, block_rows=100).collect()
    sizes = Counter(r.block for r in placed if not r.extra)
    assert sum(sizes.values()) == len(ids) and max(sizes.values()) <= 200
    extra = sorted(((r.block, r.doc_id) for r in placed if r.extra))
    firsts = {}
    for r in placed:
        if not r.extra:
            firsts[r.block] = min(firsts.get(r.block, 1 << 63), NO_ID if r.doc_id is None else r.doc_id)
    want = [firsts[b] for b in sorted(firsts)]
    assert [NO_ID if i is None else i for _, i in extra] == want[1:] + want[:1]


def test_closed_syncmers_do_not_depend_on_context():
    rng = np.random.default_rng(1)
    middle = rng.integers(97, 123, 400, dtype=np.uint8).tobytes()
    one, at_one = syncmers.anchors(middle)
    two, at_two = syncmers.anchors(b"other words before " + middle + b" and after")
    inside = dict(zip((at_two - 19).tolist(), two.tolist(), strict=True))
    assert len(one) > 20 and all(inside[p] == h for h, p in zip(one.tolist(), at_one.tolist(), strict=True))


def test_fingerprints_keep_all_anchors_of_long_texts(spark):
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(20_050)]
    passage = " ".join(words[:50])
    texts = [" ".join([*words[50:10_000], passage, *words[10_000:10_050]]), " ".join([*words[10_050:], passage])]
    out = syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    at = {}
    for r in out:
        hashes, places = syncmers.of_text(r.fingerprint)
        every, places_of_all = syncmers.anchors(texts[r.doc_id].encode())
        assert set(places.tolist()) <= set(places_of_all.tolist()) and len(hashes) >= 0.999 * len(np.unique(every))
        at[r.doc_id] = dict(zip(hashes.tolist(), places.tolist(), strict=True))
    # The shared passage has more anchors than a tenth of its bytes, in the same order in both.
    shared = len(at[0].keys() & at[1].keys())
    assert shared > len(passage) // 10
    near = {r.doc_id: r.near_next for r in out}
    assert abs(near[0] - 2 * shared / (len(at[0]) + len(at[1]))) < 0.001 and near[0] == near[1] > 0
    assert all(0.6 < r.near_edited < 0.9 for r in out)


def test_short_texts_have_fingerprints():
    rng = np.random.default_rng(4)
    texts = sorted({rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in range(1, 15) for _ in range(60)})
    prints = [syncmers.fingerprint(t) for t in texts]
    assert all(len(p[0]) for p in prints)
    none = syncmers.fingerprint(b"")
    for t, p, after in zip(texts, prints, prints[1:] + prints[:1], strict=True):
        assert syncmers.likeness(p, p) == 1 and syncmers.likeness(p, none) == 0 and syncmers.likeness(p, after) < 1, t


def test_fingerprints_as_text():
    for places in ([0], [3, 7, 262, 263, 700, 100_000]):
        own = np.arange(len(places), dtype=np.uint32) + np.uint32(4_000_000_000), np.array(places)
        back = syncmers.of_text(syncmers.text_of(own))
        assert back[0].tolist() == own[0].tolist() and back[1].tolist() == places


def test_packing_is_whole_and_tight(spark):
    cut = packing.pieces(spark.read.parquet(f"{SF_DIR}/documents.parquet"), vocabularies.path("byte_bpe_50k.json"))
    check_packed(packing.packed(cut).collect(), 0.97)


def test_packing_edges(docs, empty):
    path = vocabularies.path("byte_bpe_50k.json")
    rows = packing.packed(packing.pieces(docs, path)).collect()
    check_packed(rows, 0.0)
    reference = tokenizers.Tokenizer.from_file(path)
    counts = {i: len(reference.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts()}
    assert {r.doc_id: r.doc_tokens for r in rows} == counts
    assert packing.packed(packing.pieces(empty, path)).collect() == []


def check_packed(rows, least):
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = []
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        used.append(at)
    assert sum(used) >= least * 2048 * len(used)


def test_column_generation_is_optimal():
    demand = np.zeros(10, dtype=np.int64)
    demand[[5, 3, 2]] = 30, 30, 40  # sizes 6, 4, 3 in 10: 30 x (6 + 4), and 3 + 3 + 3
    plan = packing.plan_patterns(demand, 10)
    assert sum(n for _, n in plan) == 44 and (sum(c * n for c, n in plan) == demand).all()


def test_bpe_equals_the_library(docs):
    path = vocabularies.path("word_bpe_49k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    reference.no_truncation()
    for r in bpe.encoded(docs, path).collect():
        ids = reference.encode(dict(texts())[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == reference.decode(ids, skip_special_tokens=False)


def test_bpe_of_runs():
    coder = bpe.Encoder(bpe.load_vocabulary(vocabularies.path("word_bpe_49k.json")))
    reference = tokenizers.Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    words = ["a" * n for n in range(40)] + ["ab" * 9, "lll'll", "ΟΔΟΣ", "İ", "ﬀ", "x\x1cy", "\u0085z", "é"]
    for word, ids in zip(words, coder.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(word, add_special_tokens=False).ids


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(
        [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\nX: y", None), (4, "d", ""), (4, "d", ""), (5, "e", "é" * 9)],
        "page_id long, url string, html string",
    )
    archive = warc_archive.write_archive(pages, warc_archive.Archive.new(spark))
    records = warc_archive.read_archive(spark, archive)
    kind = warc_archive.header_field("WARC-Type").alias("kind")
    assert found(records, "id", kind) == [
        (1, "response"), (2, "revisit"), (3, "response"), (4, "revisit"), (4, "revisit"), (5, "response"),
    ]
    assert spark.read.parquet(archive.payloads).count() == 3
    for r in warc_archive.original(records).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[length:] == b"\r\n\r\n"
    small = warc_archive.write_archive(pages, warc_archive.Archive.new(spark), least_bytes=1)
    kinds = found(warc_archive.read_archive(spark, small), "id", kind)
    assert kinds.count((4, "response")) == 2


def test_scores_against_plain_counts(spark, plain):
    out = {r.doc_id: r for r in entry.queries()["op1_lm_scoring"](spark, "/root/testdata/sf0.01").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    mean = [np.mean([out[i].score for i, q in good.items() if q == k]) for k in (0, 1)]
    assert mean[1] < mean[0] and len(out) == 1000
    target = plain.where("doc_id IN (6, 7)").select("doc_id")
    scored = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(plain, target).collect()}
    assert scored[2].n_tokens == scored[3].n_tokens == 0 and scored[2].score == 0
    assert scored[6].score < scored[8].score


def test_model_sums_to_one(spark):
    """Of all pairs of a small vocabulary, told by texts that hold each of them."""
    texts = ["a b", "a c a", "c", "b b a", "a a"]
    spread = ["b a c b c c"]  # with the texts: every pair, start and end among them
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + spread)], "doc_id long, text string")
    rows = lm_scoring.marked(docs, docs.where("doc_id < 2").select("doc_id"), "doc_id", "text")
    made = stage(lm_scoring.blocks(rows.coalesce(1)), "blocks")
    n, n_target = made.agg(F.sum("n"), F.sum("n_target")).first()
    told = lm_scoring.answers(lm_scoring.questions(made, 2), 4).orderBy("block", "bucket").collect()
    data = made.first().texts
    counts = np.array([np.concatenate(c) for c in zip(*(lm_scoring.unpacked(r.data) for r in told))])
    block = lm_scoring._Block(data)
    for bits in lm_scoring._losses(block, counts, (n, n_target), 16.0):
        for context in range(4):
            at = block.before == context
            # The start has no end after it: what that lacks is the end's share of the prior.
            listed = np.exp2(-bits[at]).sum()
            assert listed <= 1 + 1e-12
            assert context == 0 or set(block.after[at]) != {0, 1, 2, 3} or abs(listed - 1) < 1e-12
    assert (n, n_target) == (sum(len(t.split()) + 1 for t in texts + spread), 7)


def test_scores_use_every_word_and_pair(spark):
    """Against counts of all words in one process, on a corpus with words too rare for any share."""
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(words, 4000)) for _ in range(100)]
    texts += ["w1 rare0 w2", "w1 rare0 w2", "rare1 w1 rare0 rare2 rare3 rare4", "", "w1"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string")
    wanted = set(range(90, 102))
    target = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    out = lm_scoring.cross_entropy_difference(docs, target).collect()
    single, pair, context = ([Counter(), Counter()] for _ in range(3))
    for i, text in [*rows, rows[-1]]:
        for k in (0, 1) if i in wanted else (1,):
            ws = text.split()
            if ws:
                single[k].update([*ws, None])
                pair[k].update(zip(["", *ws], [*ws, None]))
    for k in (0, 1):
        for (c, _), n in pair[k].items():
            context[k][c] += n

    def unigram(w, k):
        share = single[1][w] / sum(single[1].values())
        return share if k else (single[0][w] + 16 * share) / (sum(single[0].values()) + 16)

    def entropy(text, k):
        ws, total = text.split(), 0.0
        for c, w in zip(["", *ws], ws):
            total -= np.log2((pair[k][c, w] + 16 * unigram(w, k)) / (context[k][c] + 16))
        return total / max(len(ws), 1)

    for k in (0, 1):
        for c in ("", "w1", "rare0", "rare4"):
            every = [(pair[k][c, w] + 16 * unigram(w, k)) / (context[k][c] + 16) for w in single[1]]
            assert abs(sum(every) - 1) < 1e-9
    assert len(out) == len(texts) + 1 and Counter(r.doc_id for r in out)[104] == 2
    for r in out:
        if r.doc_id >= 98:
            h = [entropy(texts[r.doc_id], k) for k in (0, 1)]
            assert np.allclose([r.h_target, r.h_background, r.score], [*h, h[0] - h[1]]), r
            assert r.n_tokens == len(texts[r.doc_id].split())


def test_scores_of_odd_rows(spark, monkeypatch):
    """Nulls, clashing columns, one block a text and many buckets: the same scores for the same texts."""
    rows = [(None, "a b c", 1, 2), (2, None, 1, 2), (3, "a b c", None, 2), (3, "a b c", 1, 2), (4, " ", 1, 2), (5, "x " * 5000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, score int")
    target = spark.createDataFrame([(3,), (77,), (None,)], "doc_id long")
    once = sorted(map(str, lm_scoring.cross_entropy_difference(docs, target).collect()))
    assert len(once) == 6 and sum("doc_id=None" in r for r in once) == 1 and sum("n_tokens=0" in r for r in once) == 2
    nobody = lm_scoring.cross_entropy_difference(docs, target.where("doc_id = 77")).where("doc_id = 5").first()
    share = 5000 / (5000 + 1 + 3 * 4)
    assert abs(nobody.h_target + np.log2(share)) < 1e-9
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 1)
    monkeypatch.setattr(lm_scoring, "BUCKET_KEYS", 10)
    many = sorted(map(str, lm_scoring.cross_entropy_difference(docs.coalesce(1), target).collect()))
    assert many == once


def test_empty_tables(spark, empty):
    path = vocabularies.path("word_bpe_49k.json")
    none = empty.select("doc_id")
    for df in (
        exact_dedup.exact_groups(empty),
        exact_dedup.drop_copies(empty),
        secret_scan.secret_spans(empty),
        secret_scan.masked(empty),
        language_id.languages(empty, None),
        substring_dedup.without_repeats(empty),
        simhash.near_groups(empty),
        syncmers.fingerprints(empty),
        bpe.encoded(empty, path),
        lm_scoring.cross_entropy_difference(empty, none),
    ):
        assert df.collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, state = docs.columns, docs
    results = []
    for _, step in pipeline.STAGES:
        state = pipeline.stage(step(spark, state, SF_DIR), "test")
        results.append(state)
    assert all(r.columns == columns for r in results[:-1])
    rows = dict(documents(spark))
    letters = {i: t for i, t in rows.items() if any(map(str.isalpha, t or ""))}
    last: dict[str, int] = {}
    for i in sorted(letters):
        last[brute.folded(letters[i])] = i
    unique = {i: letters[i] for i in last.values()}
    stay = {c for *_, c in brute.simhash(unique.items())}
    assert [{r.doc_id for r in x.select("doc_id").collect()} for x in results] == [
        set(letters), set(unique), stay, stay, stay,
    ]


def test_slices_are_bounded():
    from postsift.llm.common import slices

    batch = pa.record_batch({"text": ["x" * n for n in (10, 5000, 10, 10, 3000)]})
    parts = list(slices(iter([batch]), 4000))
    assert sum(p.num_rows for p in parts) == 5 and all(p.num_rows == 1 or p.nbytes <= 4000 for p in parts)


def test_digests_join_spans():
    text, digest = secret_scan.digests([("hex", 1, 30), ("assign", 2, 40)])
    assert text == "hex:1:30,assign:2:40" and digest == hashlib.sha256(text.encode()).hexdigest()


def test_every_label_is_learnt(spark):
    rare = [(i, f"wort{i} nur hier einmal", f"l{i:03d}", 1) for i in range(300)]
    many = [(1000 + i, f"common words number {i} of one language", "en", 1) for i in range(9000)]
    docs = spark.createDataFrame([*rare, *many], SCHEMA.format("n_chars int"))
    sample = language_id.learning_sample(docs, "doc_id", "text", "lang")
    told = {lang for i, _, lang, _ in rare if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {lang for lang, _ in sample} == told | {"en"} and len(sample) <= language_id.MOST_WINDOWS


def test_null_labels_are_filled(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    network = language_id.trained(docs)
    bare = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    filled = language_id.with_language(bare, network, lang_col="lang")
    told = {r.doc_id: r.lang_pred for r in language_id.languages(docs, network).collect()}
    was = {r.doc_id: r.lang for r in bare.collect()}
    got = {r.doc_id: r.lang for r in filled.collect()}
    assert got and got == {i: was[i] if was[i] is not None else told[i] for i in got}


def test_records_have_all_mandatory_fields(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, None, "x"), (3, "u", None)], "page_id long, url string, html string")
    archive = warc_archive.write_archive(pages, warc_archive.Archive.new(spark), date="2024-01-31T00:00:00Z")
    for r in warc_archive.read_archive(spark, archive).collect():
        fields = dict(line.split(": ", 1) for line in bytes(r.header).decode().split("\r\n\r\n")[0].split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
        assert fields["WARC-Date"] == "2024-01-31T00:00:00Z"


def test_hub_joins_are_split(spark):
    """A node with very many neighbours, small joins not broadcast: the final plan deals it out."""
    from postsift.llm import components as stars
    from postsift.session import scratch_path

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 200_001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
        both = edges.unionByName(spark.range(300_000, 300_100).selectExpr("id AS u", "id - 1 AS v"))
        joined = stars._large_star(both, scratch_path(spark, "least"))
        assert joined.count() == 200_100
        plan = joined._jdf.queryExecution().executedPlan()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString() or "skew=true" in plan.toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
