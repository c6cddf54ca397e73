"""Mail-shaped views of the benchmark tables.

The tables hold no mail, so each view derives one mail shape from every row of one table.
A view is a list of SQL expressions that read the same in Spark and DuckDB; the few
spellings that differ are filled in per dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base64_line, swap

SPARK = {
    "div": "div",
    "ms": "unix_millis(cast(ts as timestamp))",
    "b64": "regexp_replace(base64(cast({} as binary)), '[^A-Za-z0-9+/=]', '')",
    "bytes": "octet_length({})",
}
DUCKDB = {
    "div": "//",
    "ms": "(epoch_us(ts) // 1000)",
    "b64": "base64(encode({}))",
    "bytes": "strlen({})",
}

# 2024-01-31T00:00:00Z: after the last event, so that every run sees the same "now".
NOW_MS = 1706659200000
START_MS = 1704067200000

_PLANTED = """CASE doc_id % 10
  WHEN 0 THEN ' ssn 123-45-' || (1000 + doc_id % 9000) || ' end'
  WHEN 1 THEN ' card 4111 1111-1111 ' || (1000 + doc_id % 9000)
  WHEN 2 THEN ' key AKIAABCDEFGH' || (10000000 + doc_id % 1000)
  WHEN 3 THEN ' Authorization: Bearer  tok.' || doc_id || '-x_y~z+/=='
  WHEN 4 THEN ' -----BEGIN PRIVATE KEY-----' || chr(10) || 'MIIE' || doc_id || chr(10)
              || '-----END PRIVATE KEY----- tail'
  WHEN 5 THEN ' é123-45-6789é'
  WHEN 6 THEN ' Your verification code is ' || (100000 + doc_id % 900000)
  WHEN 7 THEN ' card 4111111111111111.'
  ELSE '' END"""

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "fx_mail": (
        "documents",
        {
            "id": "'msg' || doc_id",
            "doc_id": "doc_id",
            "account": "'box' || (doc_id % 7) || '@example.com'",
            "from_addr": """CASE doc_id % 5
              WHEN 0 THEN 'Sender ' || (doc_id % 40) || ' <User' || (doc_id % 40) || '@Example.com>'
              WHEN 1 THEN 'user' || (doc_id % 40) || '@plain.example'
              WHEN 2 THEN '"Quoted, ' || (doc_id % 40) || '" <q' || (doc_id % 40) || '@quoted.example>'
              WHEN 3 THEN 'Updates <Notify@YourCompany.com>'
              ELSE '<s' || (doc_id % 40) || '@x.example>' END""",
            "subject": "substring(text, 1, 90)",
            "snippet": "substring(text, 1, 40)",
            "label_csv": """CASE doc_id % 6 WHEN 0 THEN 'INBOX' WHEN 1 THEN 'CATEGORY_PROMOTIONS'
              WHEN 2 THEN 'INBOX,CATEGORY_SOCIAL' WHEN 3 THEN 'SPAM' WHEN 4 THEN 'STARRED'
              ELSE '' END""",
            "unsubscribe": """CASE doc_id % 4 WHEN 0 THEN '<mailto:out' || doc_id || '@x.example>'
              WHEN 1 THEN '' END""",
            "body": f"text || {_PLANTED}",
            "received_at": f"{START_MS} + (doc_id * 7919 % 43200) * 60000",
        },
    ),
    "fx_pending": (
        "events",
        {
            "id": "'e' || event_id",
            "from_addr": """CASE user_id % 3
              WHEN 0 THEN 'Person ' || user_id || ' <p' || user_id || '@people.example>'
              WHEN 1 THEN 'p' || user_id || '@bare.example'
              ELSE '"Team ' || user_id || '" <t' || user_id || '@teams.example>' END""",
            "subject": "'Subject ' || event_id",
            "summary": "event_type || ' by user ' || user_id || ' no ' || event_id",
            "priority": """CASE event_type WHEN 'error' THEN 'High' WHEN 'signup' THEN 'High'
              WHEN 'purchase' THEN 'Medium' WHEN 'click' THEN 'Low' ELSE 'Not Necessary' END""",
            "received_at": "{ms}",
            "sent_at": """CASE WHEN event_id % 3 = 0
              THEN {ms} + 60000 * (1 + event_id % 97) END""",
        },
    ),
    "fx_push": (
        "events",
        {
            "event_id": "event_id",
            "ts": "{ms}",
            "body": """CASE
              WHEN event_id % 33 = 0 THEN 'not json'
              WHEN event_id % 33 = 11 THEN '{{"message":{{"data":"!!!","messageId":"p' || event_id || '"}}}}'
              WHEN event_id % 33 = 22 THEN '{{"other":1}}'
              ELSE '{{"message":{{"data":"' || {payload_b64} || '","messageId":"p' || event_id || '"}}}}'
                   || CASE WHEN event_id % 17 = 0 THEN ' trailing' ELSE '' END
              END""",
        },
    ),
    "fx_notification": (
        "events",
        {
            "event_id": "event_id",
            "account": "'box' || ((event_id - event_id % 5) % 7) || '@example.com'",
            "history_id": "'' || (event_id - event_id % 5)",
            "ts": "{ms}",
        },
    ),
    "fx_feed": (
        "events",
        {
            "account": "'box' || (user_id % 20) || '@example.com'",
            "box": "user_id % 20",
            "event_type": "event_type",
            "entry_id": "event_id + 1",
            "message_id": "CASE WHEN event_type <> 'view' THEN 'm' || (event_id - event_id % 3) END",
            "page_no": "event_id {div} 50",
            "received_at": "{ms}",
        },
    ),
    "fx_attempt": (
        "events",
        {
            "message_id": "'m' || (event_id {div} 5)",
            "rank": "cast(event_id % 5 as int)",
            "status": "CASE event_type WHEN 'signup' THEN 404 WHEN 'error' THEN 500 ELSE 200 END",
            "content": """CASE event_type
              WHEN 'click' THEN CASE event_id % 4
                WHEN 0 THEN '{{"priority":"High","summary":"Answer ' || event_id || '","label":"Work Items!"}}'
                WHEN 1 THEN '```json' || chr(10) || '{{"priority":"Low","summary":"Fenced ' || event_id || '"}}' || chr(10) || '```'
                WHEN 2 THEN '{{"priority":"Critical","summary":"' || repeat('long ', 40) || event_id || '","label":"Alert"}}'
                ELSE ' {{"summary":null,"label":"A-b_c 9","priority":"Not Necessary"}} ' END
              WHEN 'view' THEN '{{"priority":"High","summary":"x"}} trailing'
              WHEN 'purchase' THEN '{{"priority":"Urgent","summary":"x"}}'
              ELSE '' END""",
        },
    ),
    "fx_call": (
        "events",
        {
            "service": "'scorer'",
            "id": "event_id",
            "ts": "{ms}",
            "ok": "event_type IN ('click', 'purchase')",
        },
    ),
    "fx_account": (
        "customer",
        {
            "email": """CASE c_custkey % 10 WHEN 0 THEN '__primary__'
              ELSE 'box' || c_custkey || '@mail' || c_nationkey || '.example' END""",
            "key": "c_custkey",
            "nation": "c_nationkey",
            "added_at": "c_custkey",
        },
    ),
    "fx_account_request": (
        "customer",
        {
            "email": """CASE c_custkey % 4
              WHEN 0 THEN '  Box' || c_custkey || '@Mail' || c_nationkey || '.Example '
              WHEN 1 THEN 'NEW' || (c_custkey - c_custkey % 8) || '@mail.example'
              WHEN 2 THEN 'bad address' || c_custkey || '@mail.example'
              ELSE 'nobody' || c_custkey END""",
            "added_at": "1000000 + c_custkey",
        },
    ),
}

_PAYLOAD = (
    "('{{\"emailAddress\":\"' || CASE WHEN event_id % 13 = 0 THEN 'nobody' ELSE 'box' || "
    "((event_id - event_id % 5) % 7) || '@example.com' END || '\",\"historyId\":' || "
    "(event_id - event_id % 5) || '}}')"
)


def view_columns(name: str, dialect: dict[str, str]) -> tuple[str, dict[str, str]]:
    table, columns = VIEWS[name]
    words = {"div": dialect["div"], "ms": dialect["ms"]}
    payload = _PAYLOAD.format()
    words["payload_b64"] = dialect["b64"].format(payload)
    return table, {alias: expr.format(**words) for alias, expr in columns.items()}


def view_sql(name: str) -> str:
    """The view as a DuckDB subquery."""
    table, columns = view_columns(name, DUCKDB)
    return f"SELECT {', '.join(f'{e} AS {a}' for a, e in columns.items())} FROM {table}"


def read_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = view_columns(name, SPARK)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.selectExpr(*[f"{e} AS {a}" for a, e in columns.items()])


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_mail`` as parsed mail: labels, headers and empty attachments."""
    rows = read_view(spark, sf_dir, "fx_mail")
    header = F.when(
        F.col("unsubscribe").isNotNull(),
        F.create_map(F.lit("list-unsubscribe"), F.col("unsubscribe")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return rows.withColumn(
        "labels", F.filter(F.split("label_csv", ","), lambda label: label != "")
    ).withColumn("headers", header)


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "fx_pending")


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed pages of at most 50 entries: ``(account, page_no, page JSON)``."""
    added = F.when(
        F.col("message_id").isNotNull(),
        F.array(F.struct(F.struct(F.col("message_id").alias("id")).alias("message"))),
    )
    entry = F.struct(F.col("entry_id").cast("string").alias("id"), added.alias("messagesAdded"))
    page = F.struct(
        F.max("entry_id").cast("string").alias("historyId"),
        F.collect_list(entry).alias("history"),
    )
    return (
        read_view(spark, sf_dir, "fx_feed")
        .groupBy("account", "page_no")
        .agg(F.to_json(page).alias("page"))
    )


def feed_accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accounts, their cursors, and the status of their first feed read.

    Boxes 15, 16 and 19 have no cursor, the others one halfway through their feed; box 17
    gets a gap (404) and boxes 18 and 19 an expired token (401).
    """
    boxes = read_view(spark, sf_dir, "fx_feed").groupBy("account", "box").agg(
        F.expr("cast(max(entry_id) div 2 as string)").alias("cursor")
    )
    accounts = boxes.select("account")
    cursors = boxes.where(~F.col("box").isin(15, 16, 19)).select("account", "cursor")
    status = boxes.where(F.col("box") >= 17).select(
        "account", F.when(F.col("box") == 17, 404).otherwise(401).alias("status")
    )
    return accounts, cursors, status


def processed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages handled before: those of purchases."""
    return (
        read_view(spark, sf_dir, "fx_feed")
        .where("event_type = 'purchase'")
        .groupBy("message_id")
        .agg(F.min("received_at").alias("processed_at"))
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in very few files, shared out as a table in many files would be."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _encoded(text: Column) -> Column:
    """URL-safe base64 without padding, as mail providers send it."""
    line = base64_line(text.cast("binary"))
    return swap(swap(swap(line, "+", "-"), "/", "_"), "=", "")


def provider_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_mail`` as provider JSON: ``(doc_id, message, pdf)``; every 50th is broken.

    multipart/mixed of: an empty text part; an alternative with the HTML body (even
    documents only) and the plain body; a named text; a PDF; seven images, of which some
    repeat a Content-ID, some are only in the attachment store, and some are too large.
    """
    mail = _spread(read_view(spark, sf_dir, "fx_mail"))
    body = F.col("body")
    html = F.concat(F.lit("<p>"), F.col("subject"), F.lit("</p>&amp; "), body)
    even = F.col("doc_id") % 2 == 0
    alternative = _part(
        "multipart/alternative",
        parts=F.array(
            _part("text/html", F.when(even, _encoded(html)), F.length(html), nested=False),
            _part("text/plain", _encoded(body), F.length(body), nested=False),
        ),
    )
    images = []
    for i in range(7):
        stored = i % 2 == 1
        images.append(
            _part(
                "Image/PNG; name=x",
                None if stored else _encoded(_image(i)),
                F.when(F.col("doc_id") % 13 == i, 1048577).otherwise(1048576),
                attachment_id=f"img{i}" if stored else None,
                cid=F.when(F.col("doc_id") % 3 == 0, "<same@cid>") if i in (2, 3) else None,
            )
        )
    parts = F.array(
        _part("text/plain", F.lit(""), F.lit(0)),
        alternative,
        _part("text/plain", _encoded(body), F.length(body), filename="note.txt"),
        _part("application/pdf", None, F.lit(1000), filename="a.pdf", attachment_id="pdf"),
        *images,
    )
    header = [
        ("FROM", F.lit("old@x.example")),
        ("From", F.col("from_addr")),
        ("Subject", F.col("subject")),
        ("List-Unsubscribe", F.col("unsubscribe")),
    ]
    headers = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in header])
    message = F.struct(
        "id",
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("threadId"),
        "snippet",
        F.filter(F.split("label_csv", ","), lambda label: label != "").alias("labelIds"),
        F.struct(
            F.lit("multipart/mixed").alias("mimeType"),
            F.filter(headers, lambda h: h["value"].isNotNull()).alias("headers"),
            parts.alias("parts"),
        ).alias("payload"),
    )
    pdf = F.concat(
        F.lit("%PDF-1.4 stream\n(BT (hidden) ET endstream BT ("),
        _pdf_literal(F.col("body")),
        F.lit(") Tj <48692121> ET"),
    )
    return mail.select(
        "doc_id",
        F.when(F.col("doc_id") % 50 == 49, "{broken").otherwise(F.to_json(message)).alias("message"),
        _encoded(pdf).alias("pdf"),
    )


def _part(
    mime: str,
    data: Column | None = None,
    size: Column | None = None,
    filename: str | None = None,
    attachment_id: str | None = None,
    cid: Column | None = None,
    parts: Column | None = None,
    nested: bool = True,
) -> Column:
    """A MIME part; absent fields are NULL, which ``to_json`` leaves out."""
    header = "struct<name:string,value:string>"
    body = "struct<data:string,size:bigint,attachmentId:string>"
    leaf = f"struct<mimeType:string,filename:string,headers:array<{header}>,body:{body}>"
    headers = F.lit(None).cast(f"array<{header}>")
    if cid is not None:
        content_id = F.struct(F.lit("Content-ID").alias("name"), cid.alias("value"))
        headers = F.when(cid.isNotNull(), F.array(content_id)).otherwise(headers)
    fields = [
        F.lit(mime).alias("mimeType"),
        F.lit(filename).cast("string").alias("filename"),
        headers.alias("headers"),
        F.lit(None).cast(body).alias("body")
        if size is None
        else F.struct(
            (F.lit(None) if data is None else data).cast("string").alias("data"),
            size.cast("bigint").alias("size"),
            F.lit(attachment_id).cast("string").alias("attachmentId"),
        ).alias("body"),
    ]
    if nested:
        fields.append((F.lit(None) if parts is None else parts).cast(f"array<{leaf}>").alias("parts"))
    return F.struct(*fields)


# What would end or escape a string or a text object in a PDF, and what stands for it.
PDF_SPECIAL = (("(", " "), (")", " "), ("\\", " "), ("<", " "), ("ET", "Et"), ("BT", "Bt"))


def _pdf_literal(text: Column) -> Column:
    """``PDF_SPECIAL`` in two passes: what becomes a blank, and the T after an E or a B."""
    return F.regexp_replace(F.regexp_replace(text, r"[()\\<]|[^\x00-\x7F]+", " "), "([EB])T", "$1t")


def _image(i: int) -> Column:
    return F.concat(F.lit(f"image {i} of "), F.col("doc_id").cast("string"))


def attachment_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of ``provider_messages``: ``(message_id, attachment_id, data)``.

    Missing for every ninth document, undecodable for image 3 of every eleventh.
    """
    messages = provider_messages(spark, sf_dir)
    number = F.col("doc_id").cast("string")

    def stored(name: str, data: Column) -> Column:
        return F.struct(F.lit(name).alias("attachment_id"), data.alias("data"))

    images = [
        stored(
            f"img{i}",
            F.when((F.col("doc_id") % 11 == 0) & F.lit(i == 3), F.lit("!")).otherwise(
                _encoded(_image(i))
            ),
        )
        for i in (1, 3, 5)
    ]
    rows = F.explode(F.array(stored("pdf", F.col("pdf")), *images)).alias("a")
    return (
        messages.where("doc_id % 9 <> 0")
        .select(F.concat(F.lit("msg"), number).alias("message_id"), rows)
        .select("message_id", "a.*")
    )
