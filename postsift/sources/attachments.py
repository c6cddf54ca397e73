"""Attachments: which parts count, their bytes, and the limits per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import compute_once
from ..functions.pdf import pdf_objects, pdf_text
from ..functions.text import (
    ATTACHMENT_CHARS,
    bytes_as_utf8,
    data_url,
    decode_base64url,
    normalise_mime,
    or_empty,
    redact,
    trim_text,
)
from ..session import scratch_path, stage_at
from ..tables.bitmaps import maybe_in

# Limits per message.
MAX_BYTES = 1024 * 1024
MAX_IMAGES = 5

# Lookups are broadcast to the store up to this number (about 100 MB), and shuffled beyond it.
MOST_BROADCAST = 1_000_000

# The attachment store; ``data`` is base64url.
STORE = "message_id string, attachment_id string, data string"


def attachment_leaves(nodes: Column) -> Column:
    """Nodes that can be attachments: not containers, and not the root (it is the body)."""
    return F.filter(nodes, lambda n: (F.size(n["path"]) > 0) & ~n["is_container"])


def first_of_content_id(leaves: Column) -> Column:
    """Drop a node whose Content-ID an earlier node has; nodes without one all stay."""
    cids = F.transform(leaves, lambda n: n["content_id"])
    return F.filter(
        leaves,
        lambda n, i: n["content_id"].isNull()
        | (F.array_position(cids, n["content_id"]) == i + F.lit(1)),
    )


def attachment_parts(leaves: Column) -> Column:
    """Attachment nodes in document order with their ``kind`` and clean MIME type.

    Content-ID repeats go before the type is looked at, oversize parts before their
    bytes are.
    """
    small = F.filter(
        first_of_content_id(leaves), lambda n: F.coalesce(n["size"], F.lit(0)) <= MAX_BYTES
    )
    typed = F.transform(
        small,
        lambda n: F.struct(
            n["path"].alias("path"),
            normalise_mime(n["mime"]).alias("mime_type"),
            n["filename"].alias("filename"),
            n["data"].alias("data"),
            n["size"].alias("size"),
            n["attachment_id"].alias("attachment_id"),
        ),
    )
    kinds = F.transform(typed, lambda p: p.withField("kind", _kind(p)).dropFields("filename"))
    return F.filter(kinds, lambda p: p["kind"].isNotNull())


def _kind(p: Column) -> Column:
    mime = p["mime_type"]
    return (
        F.when(mime == "application/pdf", "pdf")
        .when((mime == "text/plain") & (F.coalesce(p["filename"], F.lit("")) != ""), "text")
        .when(F.startswith(mime, F.lit("image/")), "image")
    )


def fetch_bytes(parts: DataFrame, store: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Row form of the lookup: part rows with their ``bytes``, NULL where there are none.

    ``parts(message_id, attachment_id, size, data)``; oversize rows are split off before
    the join, because a condition on the left side alone would not stop its shuffle.
    """
    small = F.coalesce(F.col("size"), F.lit(0)) <= max_bytes
    lookup = small & F.col("data").isNull() & F.col("attachment_id").isNotNull()
    fetched = (
        parts.where(lookup)
        .join(
            store.select("message_id", "attachment_id", F.col("data").alias("_stored")),
            ["message_id", "attachment_id"],
            "left",
        )
        .withColumn("bytes", decode_base64url(F.col("_stored")))
        .drop("_stored")
    )
    inline = parts.where(~lookup).withColumn(
        "bytes", F.when(small, decode_base64url(F.col("data")))
    )
    return fetched.unionByName(inline)


def with_attachments(
    messages: DataFrame,
    store: DataFrame,
    redaction: str = "reference",
    staged_at: str | None = None,
) -> DataFrame:
    """Parsed messages with ``attachment_text`` and ``images`` in place of ``nodes``.

    ``store(message_id, attachment_id, data base64url)``. Bytes are shuffled once: a first
    join moves keys alone and tells which lookups succeed, and images are cut to the first
    five usable ones per message. Up to MOST_BROADCAST lookups go to the store, so that only
    bytes that are used are shuffled, texts and PDFs cut before. With more, a filter of bits holds back
    most attachments nobody uses, the rest of the store goes to the messages by ``message_id``, and
    grouping needs no further shuffle of bytes. The messages
    are parsed and written once; the key passes read only the columns they need, and
    messages without a lookup are never shuffled. ``staged_at`` is where they are written, for
    callers who remove them once they are done with the result.
    """
    leaves = compute_once(messages, _leaves=attachment_leaves(F.col("nodes"))).drop("nodes")
    parts = compute_once(leaves, _parts=attachment_parts(F.col("_leaves"))).drop("_leaves")
    path = staged_at or scratch_path(messages.sparkSession, "messages")
    prepared = stage_at(parts.withColumn("_wanted", _wanted(F.col("_parts"))), path)
    looks_up = F.exists("_wanted", lambda w: w["lookup"].isNotNull())
    wanted = prepared.where(looks_up).select(
        F.col("id").alias("message_id"), F.col("_wanted").alias("wanted")
    )
    lookups = wanted.agg(F.sum(F.size(F.array_compact("wanted.lookup")))).first()[0] or 0
    chosen = _chosen(wanted, store)
    if lookups <= MOST_BROADCAST:
        fetched = _fetch_few(chosen, store, redaction)
    else:
        fetched = _fetch_many(stage_at(chosen, f"{path}-chosen"), store, redaction)
    nothing = F.lit(None).cast(fetched.schema["_fetched"].dataType)
    joined = (
        prepared.where(looks_up)
        .join(fetched, "id", "left")
        .unionByName(prepared.where(~looks_up).withColumn("_fetched", nothing))
    )
    complete = compute_once(joined, _parts=F.transform("_parts", _with_content))
    return _limited(complete, redaction).drop("_fetched", "_parts", "_wanted")


def _wanted(parts: Column) -> Column:
    """What the key passes need of the parts, without their data."""
    return F.transform(
        parts,
        lambda p: F.struct(
            p["kind"].alias("kind"),
            F.when(p["data"].isNull(), p["attachment_id"]).alias("lookup"),
            p["data"].isNotNull().alias("inline"),
        ),
    )


def _chosen(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """``(message_id, chosen)``: the lookups worth fetching, images only as far as used.

    Which images are the first five usable ones depends on which lookups succeed. That is only asked for
    the images of messages with more than five; all other attachments of the store stay undecoded here.
    """
    images = F.filter("wanted", lambda w: w["kind"] == "image")
    texts = F.filter("wanted", lambda w: w["kind"] != "image")
    too_many = F.size(images) > MAX_IMAGES
    asked = wanted.where(too_many).select(
        "message_id", F.explode(F.array_compact(F.transform(images, lambda w: w["lookup"]))).alias("attachment_id")
    )
    keys = ["message_id", "attachment_id"]
    stored = maybe_in(store.select(*keys, "data"), asked, keys)
    present = (
        compute_once(stored, _usable=decode_base64url(F.col("data")).isNotNull())
        .where("_usable")
        .select(*keys)
        .join(asked, keys, "left_semi")
        .groupBy("message_id")
        .agg(F.collect_set("attachment_id").alias("present"))
    )
    found = F.filter(
        images,
        lambda w: w["inline"] | F.coalesce(F.array_contains("present", w["lookup"]), F.lit(False)),
    )
    first = F.when(too_many, F.slice(found, 1, MAX_IMAGES)).otherwise(images)
    kept = F.filter(F.concat(first, texts), lambda w: w["lookup"].isNotNull())
    return wanted.join(present, "message_id", "left").select("message_id", kept.alias("chosen"))


KINDS = ("image", "text", "pdf")


def _kinds() -> list[Column]:
    """What an attachment serves as; parts of different types may share one."""
    return [
        F.exists(
            "chosen", lambda c: (c["lookup"] == F.col("attachment_id")) & (c["kind"] == kind)
        ).alias(kind)
        for kind in KINDS
    ]


def _decoded(rows: DataFrame) -> DataFrame:
    """``data`` as bytes, without rows that cannot be read; decoded once, after any join before it."""
    return compute_once(rows, data=decode_base64url(F.col("data"))).where("data IS NOT NULL")


def _fetched(rows: DataFrame, redaction: str) -> DataFrame:
    """``(id, _fetched)``: image bytes, cut texts and PDF text objects per message."""
    content = F.struct(
        "attachment_id",
        F.when(F.col("image"), F.col("data")).alias("bytes"),
        F.when(F.col("text"), clean_text(F.col("data"), redaction)).alias("text"),
        pdf_objects(F.when(F.col("pdf"), F.col("data"))).alias("objects"),
    )
    return rows.groupBy(F.col("message_id").alias("id")).agg(F.collect_list(content).alias("_fetched"))


def _lookups() -> Column:
    return F.array_distinct(F.transform("chosen", lambda c: c["lookup"]))


def _fetch_few(chosen: DataFrame, store: DataFrame, redaction: str) -> DataFrame:
    """Lookups go to the store; only what is used of its bytes is shuffled."""
    keys = chosen.select("message_id", "chosen", F.explode(_lookups()).alias("attachment_id"))
    keys = keys.select("message_id", "attachment_id", *_kinds())
    found = store.select("message_id", "attachment_id", "data").join(
        F.broadcast(keys), ["message_id", "attachment_id"]
    )
    return _fetched(_decoded(found), redaction)


def _fetch_many(chosen: DataFrame, store: DataFrame, redaction: str) -> DataFrame:
    """The same for any number of lookups: bytes go to the messages, through one exchange."""
    keys = ["message_id", "attachment_id"]
    asked = chosen.select("message_id", F.explode(_lookups()).alias("attachment_id"))
    stored = _decoded(maybe_in(store.select(*keys, "data"), asked, keys))
    joined = chosen.join(stored, "message_id")
    used = F.array_contains(F.transform("chosen", lambda c: c["lookup"]), F.col("attachment_id"))
    return _fetched(joined.where(used).select(*keys, "data", *_kinds()), redaction)


def clean_text(data: Column, redaction: str = "reference") -> Column:
    """A text attachment, redacted, trimmed and cut."""
    text = trim_text(redact(bytes_as_utf8(data), redaction))
    return F.left(text, F.lit(ATTACHMENT_CHARS))


def _with_content(p: Column) -> Column:
    """A part with its decoded inline data, or what was fetched for it."""
    stored = F.filter("_fetched", lambda f: f["attachment_id"] == p["attachment_id"])
    return F.struct(
        p["kind"].alias("kind"),
        p["mime_type"].alias("mime_type"),
        p["data"].isNotNull().alias("inline"),
        decode_base64url(p["data"]).alias("bytes"),
        F.when(p["data"].isNull(), F.try_element_at(stored, F.lit(1))).alias("stored"),
    )


def _is_broken(p: Column) -> Column:
    return p["inline"] & p["bytes"].isNull()


def _is_usable(p: Column) -> Column:
    """Has bytes, or inline data that should have been bytes."""
    return p["inline"] | (
        F.when(p["kind"] == "image", p["stored"]["bytes"].isNotNull())
        .when(p["kind"] == "text", p["stored"]["text"].isNotNull())
        .otherwise(p["stored"]["objects"].isNotNull())
    )


def _limited(joined: DataFrame, redaction: str) -> DataFrame:
    usable = F.filter("_parts", _is_usable)
    images = F.slice(F.filter(usable, lambda p: p["kind"] == "image"), 1, MAX_IMAGES)
    texts = F.filter(usable, lambda p: p["kind"] != "image")
    sorted_out = compute_once(joined, _images=images, _texts=texts)
    limited = compute_once(sorted_out, _text=budgeted_text(F.col("_texts"), redaction))
    broken = F.col("_text").isNull() | F.exists("_images", _is_broken)

    def url(p: Column) -> Column:
        return data_url(p["mime_type"], F.coalesce(p["bytes"], p["stored"]["bytes"]))

    return limited.select(
        *[c for c in joined.columns if c != "reject_reason"],
        or_empty(F.col("_text")).alias("attachment_text"),
        F.transform("_images", url).alias("images"),
        F.coalesce("reject_reason", F.when(broken, "bad_attachment")).alias("reject_reason"),
    )


def budgeted_text(parts: Column, redaction: str = "reference") -> Column:
    """Text of the parts in order, within 2000 characters; NULL after undecodable data.

    The limit depends on what redaction left of the parts before, so this is an ordered
    fold and not a running sum: PDF text is cut and then redacted, plain text is redacted
    and then cut, and the joining newline counts.
    """

    def add(text: Column, p: Column) -> Column:
        room = F.lit(ATTACHMENT_CHARS) - F.length(text)
        objects = F.coalesce(pdf_objects(p["bytes"]), p["stored"]["objects"])
        from_pdf = trim_text(redact(pdf_text(objects, room), redaction))
        from_text = F.left(
            F.when(p["inline"], clean_text(p["bytes"], redaction)).otherwise(p["stored"]["text"]),
            room,
        )
        clean = F.when(p["kind"] == "pdf", from_pdf).otherwise(from_text)
        more = F.array_join(F.filter(F.array(text, clean), lambda x: x != ""), "\n")
        return (
            F.when(text.isNull() | (room <= 0), text)
            .when(_is_broken(p), F.lit(None).cast("string"))
            .otherwise(more)
        )

    return F.aggregate(parts, F.lit(""), add)
