"""Provider messages: nested JSON to one flat row and an ordered list of MIME nodes.

A message is one row and stays one row: its MIME tree becomes an array of nodes in
document order, so body text, Content-ID repeats and limits need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import compute_once, let
from ..functions.text import (
    BODY_CHARS,
    bytes_as_text,
    decode_base64url,
    non_empty,
    normalise_mime,
    or_empty,
    redact,
    strip_html,
)

NATIVE_DEPTH = 6
_LEAF = (
    "mimeType:string,filename:string,headers:array<struct<name:string,value:string>>,"
    "body:struct<data:string,size:bigint,attachmentId:string>"
)
NODE = (
    "struct<path:array<int>,mime:string,filename:string,content_id:string,data:string,"
    "size:bigint,attachment_id:string,is_container:boolean>"
)


def _part_type(depth: int) -> str:
    """Type of a part whose children are typed ``depth`` levels down, then raw JSON."""
    parts = "string" if depth == 0 else f"array<{_part_type(depth - 1)}>"
    return f"struct<{_LEAF},parts:{parts}>"


def message_type(depth: int = NATIVE_DEPTH) -> str:
    return (
        "struct<id:string,threadId:string,snippet:string,labelIds:array<string>,"
        f"payload:{_part_type(depth)}>"
    )


def named_headers(headers: Column) -> Column:
    return F.transform(
        F.coalesce(headers, F.array()),
        lambda h: F.struct(F.lower(h["name"]).alias("key"), h["value"].alias("value")),
    )


def header_map(named: Column) -> Column:
    """Lower-case names to values; of several headers with one name the last wins.

    Sorted by name and place, the last one of a name is the one before another name.
    """
    placed = F.transform(
        F.filter(named, lambda h: h["key"].isNotNull()),
        lambda h, i: F.struct(h["key"].alias("key"), i.alias("i"), h["value"].alias("value")),
    )
    last = let(
        F.array_sort(placed),
        lambda h: F.filter(h, lambda one, i: ~F.get(h, i + F.lit(1))["key"].eqNullSafe(one["key"])),
    )
    return F.map_from_entries(F.transform(last, lambda h: F.struct(h["key"], h["value"])))


def content_id(headers: Column) -> Column:
    """Value of the first Content-ID header; NULL if there is none or it is empty."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == "content-id")
    return non_empty(F.try_element_at(found, F.lit(1))["value"])


def _below(part: Column) -> Column:
    """The children of a part whose own are raw JSON, read as a typed level would read them."""
    wrapped = F.concat(F.lit('{"parts":'), part["parts"], F.lit("}"))
    return F.from_json(wrapped, f"struct<parts:array<{_part_type(0)}>>")["parts"]


def _node(path: Column, part: Column, children: Column) -> Column:
    return F.struct(
        path.alias("path"),
        part["mimeType"].alias("mime"),
        part["filename"].alias("filename"),
        content_id(part["headers"]).alias("content_id"),
        non_empty(part["body"]["data"]).alias("data"),
        part["body"]["size"].alias("size"),
        non_empty(part["body"]["attachmentId"]).alias("attachment_id"),
        children.isNotNull().alias("is_container"),
    )


def part_nodes(part: Column, depth: int, path: Column | None = None) -> Column:
    """Nodes of a part and all below it, in document order.

    The recursion is over the column's type, so this is one expression that visits every
    part once; nothing is sorted, and no level is kept beside the next.
    """
    path = F.array().cast("array<int>") if path is None else path
    if depth == 0:
        return F.array(_node(path, part, F.when(part["parts"].isNotNull(), _below(part))))
    own = F.array(_node(path, part, part["parts"]))
    below = F.transform(
        F.coalesce(part["parts"], F.array()),
        lambda child, i: part_nodes(child, depth - 1, F.concat(path, F.array(i.cast("int")))),
    )
    return F.concat(own, F.flatten(below))


def is_deeper(part: Column, depth: int) -> Column:
    """Whether there are parts below the typed levels."""
    if depth == 0:
        return part["parts"].isNotNull()
    return F.coalesce(
        F.exists(part["parts"], lambda child: is_deeper(child, depth - 1)), F.lit(False)
    )


def _placed(path: Column, part: Column) -> Column:
    return F.struct(path.alias("path"), part.alias("part"))


def _last_typed(part: Column, depth: int, path: Column | None = None) -> Column:
    """Path and part of every part of the last typed level."""
    path = F.array().cast("array<int>") if path is None else path
    if depth == 0:
        return F.array(_placed(path, part))
    return F.flatten(
        F.transform(
            F.coalesce(part["parts"], F.array()),
            lambda child, i: _last_typed(child, depth - 1, F.concat(path, F.array(i.cast("int")))),
        )
    )


def _next_level(level: Column) -> Column:
    """Path and part of all children of a level whose parts keep theirs as raw JSON."""
    return F.flatten(
        F.transform(
            F.filter(level, lambda p: p["part"]["parts"].isNotNull()),
            lambda p: F.transform(
                F.coalesce(_below(p["part"]), F.array()),
                lambda child, i: _placed(F.concat(p["path"], F.array(i.cast("int"))), child),
            ),
        )
    )


def deep_nodes(nodes: Column, part: Column, depth: int, raw: Column) -> Column:
    """Nodes of a tree of any depth, of which ``nodes`` are the typed levels.

    A fold goes down one level a round. Every part is an object, so no tree has more levels than its
    JSON has opening braces. In order of the paths, which compare by number, a part comes before all
    below it and after all below its elder siblings.
    """

    def own(level: Column) -> Column:
        return F.transform(
            level, lambda p: _node(p["path"], p["part"], F.when(p["part"]["parts"].isNotNull(), _below(p["part"])))
        )

    rounds = F.sequence(F.lit(0), F.length(raw) - F.length(F.replace(raw, F.lit("{"), F.lit(""))))
    found = F.aggregate(
        rounds,
        F.struct(nodes.alias("nodes"), _next_level(_last_typed(part, depth)).alias("level")),
        lambda acc, _: F.when(F.size(acc["level"]) == 0, acc).otherwise(
            F.struct(
                F.concat(acc["nodes"], own(acc["level"])).alias("nodes"), _next_level(acc["level"]).alias("level")
            )
        ),
        lambda acc: acc["nodes"],
    )
    return F.array_sort(found)


def _is_text(node: Column) -> Column:
    return node["mime"].isin("text/plain", "text/html") & node["data"].isNotNull()


def text_paths(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, _is_text), lambda n: n["path"])


def body_text(nodes: Column, text_paths: Column, charset: str) -> Column:
    """First non-empty text in document order; NULL if undecodable data comes before it.

    Plain text and HTML count alike. A typed node with inline data ends its branch, even
    if its text is empty. Nothing is decoded once a text is found.
    """

    def read(n: Column) -> Column:
        plain = bytes_as_text(decode_base64url(n["data"]), charset)
        return F.when(n["mime"] == "text/html", strip_html(plain)).otherwise(plain)

    def below_text(n: Column) -> Column:
        return F.exists(
            text_paths,
            lambda p: (F.size(p) < F.size(n["path"])) & (F.slice(n["path"], 1, F.size(p)) == p),
        )

    return F.aggregate(
        nodes,
        F.lit(""),
        lambda found, n: F.when((found == "") & _is_text(n) & ~below_text(n), read(n)).otherwise(
            found
        ),
    )


def parse_messages(
    raw: DataFrame,
    column: str = "message",
    charset: str = "ISO-8859-1",
    redaction: str = "reference",
    depth: int = NATIVE_DEPTH,
    deep_trees: bool = True,
) -> DataFrame:
    """Provider JSON to ``EmailMessage`` columns plus ``nodes`` and ``reject_reason``.

    Attachment text and images come from ``sources.attachments``. A message that cannot
    be read keeps its row, with a reason; it never fails its batch.

    The default charset reads UTF-8 bodies as Latin-1, which is what has to be matched;
    pass ``UTF-8`` for readable text. ``deep_trees=False`` leaves out the fold over the
    levels below ``depth``; such messages then get the reason ``too_deep``. At those levels a
    string that holds a JSON list of objects counts as parts.
    """
    parsed = compute_once(raw, _message=F.from_json(column, message_type(depth)))
    payload = F.col("_message.payload")
    flat = compute_once(
        parsed,
        nodes=part_nodes(payload, depth),
        _deeper=is_deeper(payload, depth),
        _named=named_headers(payload["headers"]),
    )
    if deep_trees:
        deep = deep_nodes(F.col("nodes"), payload, depth, F.col(column))
        flat = compute_once(flat, nodes=F.when(F.col("_deeper"), deep).otherwise(F.col("nodes")))
    too_deep = F.lit(False) if deep_trees else F.col("_deeper")
    paths = compute_once(flat, _paths=text_paths(F.col("nodes")))
    read = compute_once(
        paths,
        _headers=header_map(F.col("_named")),
        _body=body_text(F.col("nodes"), F.col("_paths"), charset),
    )
    reason = (
        F.when(F.col("_message.id").isNull() | payload.isNull(), "bad_message")
        .when(too_deep, "too_deep")
        .when(F.col("_body").isNull(), "bad_body")
    )
    carried = [c for c in raw.columns if c != column]
    return read.select(
        *carried,
        F.col("_message.id").alias("id"),
        F.col("_message.threadId").alias("thread_id"),
        or_empty(F.col("_headers")["from"]).alias("from_addr"),
        or_empty(F.col("_headers")["subject"]).alias("subject"),
        F.col("_message.snippet").alias("snippet"),
        F.left(redact(or_empty(F.col("_body")), redaction), F.lit(BODY_CHARS)).alias("body_text"),
        or_empty(F.col("_headers")["date"]).alias("date"),
        F.coalesce(F.col("_message.labelIds"), F.array().cast("array<string>")).alias("labels"),
        F.col("_headers").alias("headers"),
        "nodes",
        reason.alias("reject_reason"),
    )


def mime_parts(messages: DataFrame) -> DataFrame:
    """One row per MIME node."""
    return messages.select(F.col("id").alias("message_id"), F.explode("nodes").alias("node")).select(
        "message_id", "node.*", normalise_mime(F.col("node.mime")).alias("mime_type")
    )
