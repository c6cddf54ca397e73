"""Text functions, all built from native Spark expressions.

The behaviour to match is defined on JavaScript strings, so three things are
spelled out instead of left to Java's defaults: what counts as white space, what
a word boundary is next to an accented letter, and where the text ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's \s and trim() treat as white space.
WHITE_SPACE = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
LINE_ENDS = r"\n\r\u2028\u2029"
# The same as classes that turn a letter away at the first look, the second one without the blank.
_ANY_SPACE = rf"\s\u00A0-\uFEFF&&[{WHITE_SPACE}]"
_ODD_SPACE = rf"\t-\r\u00A0-\uFEFF&&[{WHITE_SPACE.replace(' ', '')}]"
# And as the characters themselves.
_SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Text limits, in characters.
BODY_CHARS = 2048
PROMPT_BODY_CHARS = 1800
PROMPT_ATTACHMENT_CHARS = 1000
ATTACHMENT_CHARS = 2000
RULE_SUMMARY_CHARS = 80
TITLE_SUBJECT_CHARS = 60
LABEL_CHARS = 30
ANSWER_SUMMARY_CHARS = 120
ALERT_CHARS = 280

# Entities, replaced in this order (so "&amp;lt;" ends as "<").
HTML_ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&quot;", '"'),
)

REDACTED = "[REDACTED]"
# ASCII word boundaries, as in JavaScript: Java's own takes accented letters for word
# characters. The first digit stands before its look-behind, so that the scan skips over
# text without digits.
_FIRST_DIGIT = r"\d(?<![A-Za-z0-9_]\d)"
_WORD_START = "(?<![A-Za-z0-9_])"
_WORD_END = "(?![A-Za-z0-9_])"

# Redaction patterns, applied in this order.
REDACTIONS = (
    (r"-----BEGIN[\s\S]+?-----END[^-]+-----", REDACTED),
    (r"AKIA[0-9A-Z]{16}", REDACTED),
    (rf"Bearer[{WHITE_SPACE}]+[A-Za-z0-9\-._~+/]+=*", "Bearer " + REDACTED),
    (rf"{_FIRST_DIGIT}\d{{2}}-\d{{2}}-\d{{4}}{_WORD_END}", REDACTED),
    (rf"{_FIRST_DIGIT}\d{{3}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,4}}{_WORD_END}", REDACTED),
)

# The stricter profile: one-time codes and bare 16-digit card numbers as well.
EXTENDED_REDACTIONS = REDACTIONS + (
    (
        rf"(?i){_WORD_START}(code|pin|otp)({_WORD_END}[^0-9\n]{{0,20}})\d{{4,8}}{_WORD_END}",
        "$1$2" + REDACTED,
    ),
    (rf"{_FIRST_DIGIT}\d{{15}}{_WORD_END}", REDACTED),
)

REDACTION_PROFILES = {"reference": REDACTIONS, "extended": EXTENDED_REDACTIONS}

# Fixed value: where a message opens in the web client.
MESSAGE_LINK = "https://mail.google.com/mail/u/0/#inbox/"

# Fixed value: the shape of a valid account address.
ACCOUNT_PATTERN = rf"^[^{WHITE_SPACE}@]+@[^{WHITE_SPACE}@]+\.[^{WHITE_SPACE}@]+\z"


def trim_text(text: Column) -> Column:
    """Trim every kind of white space, not only blanks; only the ends of a text are looked at."""
    return F.btrim(text, F.lit(_SPACES))


def collapse_space(text: Column) -> Column:
    """Every run of white space as one blank; single blanks, the most of them, are no match and stay."""
    return F.regexp_replace(text, rf" [{_ANY_SPACE}]+|[{_ODD_SPACE}][{_ANY_SPACE}]*", " ")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def non_empty(text: Column) -> Column:
    """NULL for an empty text, so that ``coalesce`` can go on to the next choice."""
    return F.nullif(text, F.lit(""))


def strip_html(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, char in HTML_ENTITIES:
        out = F.regexp_replace(out, entity, char)  # finds a literal several times as fast as replace
    return out


def redact(text: Column, profile: str = "reference") -> Column:
    for pattern, replacement in REDACTION_PROFILES[profile]:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def swap(text: Column, char: str, by: str) -> Column:
    """``text`` with one character put for another; ``replace`` takes several times as long over long texts."""
    return F.array_join(F.split(text, char if char.isalnum() else "\\" + char), by)


def decode_base64url(data: Column) -> Column:
    """Bytes of a base64 or base64url text; NULL where it is not one."""
    return F.try_to_binary(swap(swap(data, "-", "+"), "_", "/"), F.lit("base64"))


def bytes_as_latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def bytes_as_utf8(data: Column) -> Column:
    """Bytes read as UTF-8: bad sequences become U+FFFD, a leading BOM is dropped."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), r"^\uFEFF", "")


def bytes_as_text(data: Column, charset: str) -> Column:
    if charset.upper() in ("ISO-8859-1", "LATIN1"):
        return bytes_as_latin1(data)
    if charset.upper() in ("UTF-8", "UTF8"):
        return bytes_as_utf8(data)
    raise ValueError(f"unsupported body charset: {charset}")


def base64_line(data: Column) -> Column:
    """Base64 without the line breaks that Spark puts into long texts."""
    return swap(swap(F.base64(data), "\r", ""), "\n", "")


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_line(data))


def normalise_mime(mime: Column) -> Column:
    return F.lower(trim_text(F.substring_index(mime, ";", 1)))


def normalise_account(email: Column) -> Column:
    return F.lower(trim_text(email))


def is_account(email: Column) -> Column:
    return F.coalesce(email.rlike(ACCOUNT_PATTERN), F.lit(False))


def sender_address(sender: Column) -> Column:
    """Lower-case address: inside the first ``<...>``, else the whole text."""
    inside = non_empty(F.regexp_extract(sender, "<([^>]+)>", 1))
    return F.lower(F.coalesce(inside, sender))


def sender_name(sender: Column) -> Column:
    """Display name, else the part before ``@``, else the raw text."""
    before = F.regexp_extract(sender, rf"^([^{LINE_ENDS}]+?)[{WHITE_SPACE}]*<", 1)
    unquoted = F.regexp_replace(trim_text(before), r"""^["']|["']\z""", "")
    return F.coalesce(
        non_empty(unquoted), non_empty(F.substring_index(sender, "@", 1)), sender
    )


def message_link(message_id: Column) -> Column:
    return F.concat(F.lit(MESSAGE_LINK), message_id)


def prompt_text(
    sender: Column, subject: Column, body: Column, snippet: Column, attachment: Column
) -> Column:
    """The text a scorer sees; the attachment line only where there is text."""
    body_part = F.left(
        F.coalesce(non_empty(trim_text(body)), or_empty(snippet)), F.lit(PROMPT_BODY_CHARS)
    )
    attached = non_empty(F.left(trim_text(or_empty(attachment)), F.lit(PROMPT_ATTACHMENT_CHARS)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("From: "), sender),
        F.concat(F.lit("Subject: "), subject),
        F.concat(F.lit("Body: "), body_part),
        F.concat(F.lit("Attachment text: "), attached),
    )
