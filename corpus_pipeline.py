"""A corpus from documents: language ID, exact dedup, SimHash near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postsift.llm import exact_dedup, language_id, packing, secret_scan, simhash
from postsift.llm.common import table, tuned
from postsift.session import stage


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those without a label get the predicted language.

    The network learns from the stage's own input.

    Its scores drop nothing: those of clean short documents go down to chance (REPLY_r02.md).
    """
    tuned(spark)
    return language_id.with_language(docs, language_id.trained(docs), lang_col="lang")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the one with the largest id stays."""
    tuned(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by fingerprints that differ in at most 4 bits the smallest id stays."""
    tuned(spark)
    return simhash.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and its length counted anew."""
    tuned(spark)
    return secret_scan.masked(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    import public_tokenizers

    tuned(spark)
    return packing.packed(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", in_known_language),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# Language ID is a trained model, so SQL has no twin; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's output staged as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
