"""Literal text of a PDF, as far as it stands outside its streams.

All of it is built-in expressions: a fold over the text objects of a file that reads no further
than any budget goes. ``text_objects`` says the same for one file in plain Python; tests hold the
expressions against it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let
from .text import ATTACHMENT_CHARS, LINE_ENDS, WHITE_SPACE, collapse_space, trim_text

# What is blanked, where text stands, and the two kinds of strings.
_STREAM = re.compile(r"stream[\r\n][\s\S]*?endstream")
_TEXT_OBJECT = re.compile(r"BT\b([\s\S]*?)\bET\b", re.ASCII)
_LITERAL = re.compile(rf"\(([^)\\]*(?:\\[^{LINE_ENDS}][^)\\]*)*)\)")
_HEX = re.compile(r"<([0-9A-Fa-f]+)>")
_OCTAL = re.compile(r"\\([0-9]{3})")
# Escapes, replaced one kind after the other.
_ESCAPES = (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\"))

# The web's "latin1" is windows-1252, with C1 controls where that has no character.
_WEB_LATIN1 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
_OUTER_SPACE = re.compile(rf"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\Z")


def _octal_char(match: re.Match) -> str:
    digits = match.group(1)
    octal = re.match("[0-7]*", digits).group(0)
    return chr(int(octal, 8)) if octal else "\0"


def _unescape(text: str) -> str:
    for escape, char in _ESCAPES:
        text = text.replace(escape, char)
    return _OCTAL.sub(_octal_char, text)


def _printable_hex(digits: str) -> str:
    whole = len(digits) - len(digits) % 2
    return "".join(chr(b) for b in bytes.fromhex(digits[:whole]) if 0x20 <= b < 0x7F)


def text_objects(data: bytes) -> list[list[str]]:
    """The usable strings of each text object, in file order."""
    text = _STREAM.sub("stream endstream", data.decode("latin-1").translate(_WEB_LATIN1))
    objects = []
    for match in _TEXT_OBJECT.finditer(text):
        block = match.group(1)
        pieces = [_unescape(m.group(1)) for m in _LITERAL.finditer(block)]
        pieces += [_printable_hex(m.group(1)) for m in _HEX.finditer(block)]
        objects.append([p for p in pieces if len(_OUTER_SPACE.sub("", p)) > 1])
    return objects


# The same patterns as Java's: repeats that never have to give back what they took are possessive,
# so that no piece is too long for the stack.
_J_STREAM = r"stream[\r\n](?s:.)*?endstream"
_J_TEXT_OBJECT = (
    r"BT(?![A-Za-z0-9_])([^E]*+(?:E(?!(?<![A-Za-z0-9_]E)T(?![A-Za-z0-9_]))[^E]*+)*+)ET"
)
_J_LITERAL = rf"\(([^)\\]*+(?:\\[^{LINE_ENDS}][^)\\]*+)*+)\)"
_J_OCTAL = r"\\([0-9]{3})"
_TWO_CHARS = rf"[^{WHITE_SPACE}][{WHITE_SPACE}]*[^{WHITE_SPACE}]"

OBJECTS = "array<struct<length:int,text:string>>"


def pdf_objects(data: Column) -> Column:
    """Text objects of a file as ``(length, text)``, no more of them than any budget can take.

    ``length`` is that of the raw strings, which decides where to stop; the text is
    collapsed and cut two characters past the largest budget: one may be a leading space,
    and one keeps a space at the budget's end from being trimmed. NULL for no file.
    """
    text = F.regexp_replace(F.decode(data, "ISO-8859-1"), _J_STREAM, "stream endstream")
    start = F.struct(F.lit(0).alias("total"), F.array().cast(OBJECTS).alias("found"))

    def add(acc: Column, block: Column) -> Column:
        def more(pieces: Column) -> Column:
            length = F.length(F.array_join(pieces, ""))
            words = F.left(collapse_space(F.array_join(pieces, " ")), F.lit(ATTACHMENT_CHARS + 2))
            found = F.struct(length.alias("length"), words.alias("text"))
            return F.struct(
                (acc["total"] + length).alias("total"), F.array_append(acc["found"], found).alias("found")
            )

        grown = let(_pieces(block), lambda pieces: F.when(F.size(pieces) == 0, acc).otherwise(more(pieces)))
        return F.when(acc["total"] >= ATTACHMENT_CHARS, acc).otherwise(grown)

    return F.aggregate(_all(text, _J_TEXT_OBJECT), start, add, lambda acc: acc["found"])


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _pieces(block: Column) -> Column:
    """The usable strings of a text object: those of two characters, other than space around them."""
    literals = F.transform(_all(block, _J_LITERAL), lambda p: _unescaped(_web_latin1(p)))
    hexes = F.transform(_all(block, _HEX.pattern), _from_hex)
    return F.filter(F.concat(literals, hexes), lambda p: F.regexp_like(p, F.lit(_TWO_CHARS)))


def _web_latin1(text: Column) -> Column:
    controls = F.translate(text, "".join(map(chr, _WEB_LATIN1)), "".join(_WEB_LATIN1.values()))
    return F.when(F.regexp_like(text, F.lit(r"[\x80-\x9F]")), controls).otherwise(text)


def _unescaped(text: Column) -> Column:
    plain = text
    for escape, char in _ESCAPES:
        plain = F.replace(plain, F.lit(escape), F.lit(char))
    return F.when(F.contains(text, F.lit("\\")), let(plain, _octals)).otherwise(text)


def _octals(text: Column) -> Column:
    """Three digits after a backslash as one character: by the leading octal ones, NUL without any."""
    chars = F.transform(
        _all(text, _J_OCTAL),
        lambda digits: F.decode(F.unhex(F.lpad(F.conv(digits, 8, 16), 4, "0")), "UTF-16BE"),
    )
    joined = F.transform(F.split(text, _J_OCTAL), lambda part, i: F.concat(part, F.coalesce(F.get(chars, i), F.lit(""))))
    return F.array_join(joined, "")


def _from_hex(digits: Column) -> Column:
    whole = F.left(digits, F.length(digits) - F.length(digits) % 2)
    return F.regexp_replace(F.decode(F.unhex(whole), "ISO-8859-1"), r"[^\x20-\x7E]", "")


def pdf_text(objects: Column, max_chars: Column) -> Column:
    """Text of at most ``max_chars``; no object is begun once that many are collected."""
    start = F.struct(
        F.lit(0).alias("length"), F.array().cast("array<string>").alias("texts")
    )

    def add(acc: Column, found: Column) -> Column:
        more = F.struct(
            (acc["length"] + found["length"]).alias("length"),
            F.array_append(acc["texts"], found["text"]).alias("texts"),
        )
        return F.when(acc["length"] >= max_chars, acc).otherwise(more)

    joined = F.aggregate(objects, start, add, lambda acc: F.array_join(acc["texts"], " "))
    return F.left(trim_text(collapse_space(joined)), max_chars)
