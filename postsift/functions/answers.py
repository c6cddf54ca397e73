"""Strict JSON objects and the model's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .priorities import PRIORITIES
from .once import let
from .text import ANSWER_SUMMARY_CHARS, LABEL_CHARS, WHITE_SPACE, or_empty, trim_text

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def strict_object(text: Column, fields: str) -> Column:
    """Parse ``text`` as exactly one JSON object, else NULL.

    ``from_json`` accepts trailing junk. The text is therefore put into an array in
    front of a closing mark made from its own digest: only a text that is one whole
    object leaves the mark as the second and last element.
    """

    def parse(t: Column) -> Column:
        wrapped = F.concat(F.lit("["), t, F.lit(',{"_mark":"'), F.md5(t), F.lit('"}]'))
        return F.from_json(wrapped, f"array<struct<{fields},_mark:string>>", _STRICT)

    def check(t: Column, parsed: Column) -> Column:
        last = F.try_element_at(parsed, F.lit(2))
        whole = (F.size(parsed) == 2) & (last["_mark"] == F.md5(t))
        return F.when(whole, F.try_element_at(parsed, F.lit(1)))

    return let(text, lambda t: let(parse(t), lambda parsed: check(t, parsed)))


def script_number(number: Column) -> Column:
    """A double as a JSON consumer in JavaScript prints it: ``1``, ``0.5``, ``1e+21``, ``1e-7``."""

    def written(d: Column) -> Column:
        size, text = F.abs(d), d.cast("string")
        short = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1")
        trim = lambda places: F.regexp_replace(d.try_cast(f"decimal(38,{places})").cast("string"), "0+$", "")
        return (
            F.when((size >= 1e21) | ((size < 1e-6) & (size > 0)), F.replace(short, F.lit("E"), F.lit("e")))
            .when((size >= 2.0**53) | (d == F.floor(d)), d.try_cast("decimal(38,0)").cast("string"))
            .when(size < 1e-3, trim(30))
            .when(size >= 1e7, trim(18))
            .otherwise(text)
        )

    return let(number, written)


def _script_text(read: Column, text: Column, field: str) -> Column:
    """``read``, the field as JSON text, with numbers and arrays as JavaScript's String has them.

    Only a value that begins like one of these is looked at again for its type, so the string
    "1.0" stays as it is. Arrays inside an array, and objects, keep their JSON form.
    """

    def scalar(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
        return (
            F.when(F.is_variant_null(v), F.lit(""))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(number, script_number(F.try_variant_get(v, "$", "double")))
            .otherwise(F.to_json(v))
        )

    def by_kind(v: Column) -> Column:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), scalar)
        listed = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
        return F.coalesce(F.when(listed, F.array_join(items, ",")).otherwise(scalar(v)), read)

    value = F.try_variant_get(F.try_parse_json(text), f"$.{field}", "variant")
    return F.when(F.regexp_like(read, F.lit(r"^[-\[0-9]")), by_kind(value)).otherwise(read)


def parse_answer(raw: Column) -> Column:
    """``struct(priority, summary, label)``, or NULL for an unusable answer."""
    text = F.regexp_replace(raw, rf"(?i)^```json[{WHITE_SPACE}]*", "")
    text = trim_text(F.regexp_replace(text, rf"[{WHITE_SPACE}]*```\z", ""))

    def label(data: Column, t: Column) -> Column:
        letters = F.regexp_replace(or_empty(_script_text(data["label"], t, "label")), "[^A-Za-z0-9]", "")
        return let(F.left(letters, F.lit(LABEL_CHARS)), lambda x: F.when(x == "", "Other").otherwise(x))

    def answer(data: Column, t: Column) -> Column:
        summary = or_empty(_script_text(data["summary"], t, "summary"))
        return F.when(
            data["priority"].isin(*PRIORITIES),
            F.struct(
                data["priority"].alias("priority"),
                F.left(summary, F.lit(ANSWER_SUMMARY_CHARS)).alias("summary"),
                label(data, t).alias("label"),
            ),
        )

    fields = "priority:string,summary:string,label:string"
    return let(text, lambda t: let(strict_object(t, fields), lambda data: answer(data, t)))
