"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    clustering,
    collocations,
    exact_dedup,
    language_id,
    lm_scoring,
    packing,
    secret_scan,
    simhash,
    substring_dedup,
    syncmers,
    token_counts,
    warc_archive,
)
from .common import table
from .oracles import ORACLES  # noqa: F401 - registered with the queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much every text reads like the documents labelled as good, against all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts by kind, spans and the digest of the base spans."""
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    spans = F.array_join(
        F.transform(
            "secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(r.kind) for r in secret_scan.RULES],
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by a network that has not seen a third of them."""
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.trained(docs))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without passages of 13 words that an earlier document has."""
    left = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return left.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of(F.col("bits")).alias("fingerprint"), "component_id")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: one row per piece."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return packing.packed(cut)


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


@query
def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as a content-addressed archive and read every record back."""
    pages = table(spark, sf_dir, "pages")
    archive = warc_archive.write_archive(pages, warc_archive.Archive.new(spark))
    records = warc_archive.read_archive(spark, archive)
    refers = F.regexp_extract(warc_archive.header_field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1)
    stated = F.regexp_replace(warc_archive.header_field("WARC-Payload-Digest"), "^sha1:", "")
    digest = warc_archive.base32_sha1(F.col("payload"))
    return records.where(F.assert_true(stated == digest, "a header states another digest").isNull()).select(
        F.col("id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        stated.alias("payload_digest"),
        warc_archive.header_field("WARC-Type").alias("record_type"),
        F.when(warc_archive.header_field("WARC-Type") == "revisit", refers.cast("long")).alias("refers_to"),
    )


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of every language, with their counts."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, as lengths only."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


@query
def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest of 40 centroids after five rounds."""
    return clustering.clusters(table(spark, sf_dir, "embeddings"))
