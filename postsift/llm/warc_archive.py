"""WARC: a content-addressed archive of records, written and read back with joins.

Every row becomes a WARC record. ``payloads`` holds each distinct payload once, under its SHA-256;
``headers`` holds every record's exact header bytes apart from it, with the digest of the block it
needs (none for a revisit). Reading joins the two, checks both digests and puts the original record
back together.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the
``response``, the others are ``revisit`` records that refer to it; smaller payloads are always
responses. Payloads count as equal by SHA-256, which a SHA-512 and the length must bear out when the
payload is stored and the SHA-256 again when it is read.

Defined cases: null payloads count as empty, null URLs as an empty target; a null id is smaller than
any other and is written as an empty record name; rows that repeat an id and payload are one response
and revisits of that same id (which of the equal rows is which makes no difference); an empty table
gives an empty archive.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import release, scratch_path, stage
from . import exact_dedup
from .common import whole

# Digits of conv() and of RFC 4648 base 32.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables, in storage all executors share."""

    headers: str
    payloads: str

    @staticmethod
    def new(spark: SparkSession) -> Archive:
        root = scratch_path(spark, "warc")
        return Archive(f"{root}/headers", f"{root}/payloads")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 40 hex digits as four groups of 40 bits."""
    sha1 = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(sha1, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*groups), _CONV_DIGITS, _BASE32)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(
    pages: DataFrame,
    archive: Archive,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str | None = None,
) -> Archive:
    """Write a record for every row of ``pages``.

    ``date`` is the WARC-Date of all records, in UTC like ``2024-01-31T00:00:00Z``: when they were
    made, if it is not given.
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = whole(pages[payload_col].cast("string")).cast("binary")
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        pages[url_col].cast("string").alias("url"),
        payload.alias("payload"),
    )
    index = rows.select(
        "id",
        "url",
        F.octet_length("payload").cast("long").alias("bytes"),
        F.sha2("payload", 256).alias("sha256"),
        base32_sha1(F.col("payload")).alias("sha1"),
    )
    # Written first, so that the join can split the digest of a page that a third of all rows have.
    groups = stage(
        index.groupBy("sha256").agg(
            F.min(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("copies")
        ),
        "groups",
    )
    # Ids that repeat within a group are rare; only they need a number to tell one row apart.
    joined = index.join(groups, "sha256")
    own = F.col("id").eqNullSafe(F.col("first.id"))
    is_first = own & (F.col("copies") == 1)
    single = joined.where((F.col("bytes") < least_bytes) | is_first).withColumn("response", F.lit(True))
    others = joined.where((F.col("bytes") >= least_bytes) & ~is_first)
    later = others.where(~own).withColumn("response", F.lit(False))
    same = Window.partitionBy("sha256", "id").orderBy("url")
    tied = others.where(own).withColumn("response", F.row_number().over(same) == 1)
    records = single.unionByName(later).unionByName(tied)

    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))
    first = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.id").cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(whole("url"), r"[\r\n]", "")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    kind = F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))
    length = F.octet_length(http) + F.when(F.col("response"), F.col("bytes")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", name),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", uri),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            ~F.col("response"),
            F.concat(
                _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                _field("WARC-Refers-To", first),
            ),
        ).otherwise(""),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    records.select("id", header.cast("binary").alias("header"), "sha256", "response").write.parquet(
        archive.headers
    )
    # Each payload once. Those whose digest surely occurs once are written where they are read; of
    # the others, partial aggregation keeps one copy a task before anything is shuffled.
    probed = exact_dedup.with_maybe(
        rows.select(F.sha2("payload", 256).alias("text_sha256"), "payload"),
        exact_dedup.repeated_positions(index.select(F.col("sha256").alias("text_sha256"))),
    ).withColumnRenamed("text_sha256", "sha256")
    probed.where("NOT _maybe").select("sha256", "payload").write.parquet(archive.payloads)
    # A second digest and the length vouch for the first: unequal payloads are never stored as one.
    second = F.struct(F.sha2("payload", 512), F.octet_length("payload"))
    probed.where("_maybe").withColumn("second", second).groupBy("sha256").agg(
        F.min("payload").alias("payload"), F.min("second").alias("least"), F.max("second").alias("most")
    ).select(
        "sha256",
        F.when(F.col("least") == F.col("most"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
        .alias("payload"),
    ).write.mode("append").parquet(archive.payloads)
    release(rows.sparkSession)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records: id, header, payload (of a revisit: that of the record it refers to), sha256."""
    headers = spark.read.parquet(archive.headers)
    payloads = spark.read.parquet(archive.payloads)
    checked = payloads.where(
        F.assert_true(F.sha2("payload", 256) == F.col("sha256"), "a stored payload is damaged").isNull()
    )
    return headers.join(checked, "sha256").select("id", "header", "payload", "sha256")


def original(records: DataFrame) -> DataFrame:
    """(id, record): the bytes of each record as an archive file holds them."""
    block = F.when(header_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select(
        "id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record")
    )


def header_field(name: str, header: Column | str = "header") -> Column:
    """A field of the WARC header, or null; the fields of the HTTP header are not looked at."""
    text = F.col(header) if isinstance(header, str) else header
    fields = F.substring_index(text.cast("string"), "\r\n\r\n", 1)
    found = F.regexp_extract(fields, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(F.contains(fields, F.lit(f"\r\n{name}: ")), found)
