"""DuckDB SQL for the registered queries: the same results, stated independently.

Views are shared with the Spark side (``fixtures``); what is computed on them is not.
"""

from __future__ import annotations

from . import fixtures as fx

# The white space of JavaScript, for RE2.
WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}]"
)
DAY = 86_400_000
LINK = "https://mail.google.com/mail/u/0/#inbox/"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def redacted(x: str, extended: bool = False) -> str:
    rules = [
        (r"-----BEGIN[\s\S]+?-----END[^-]+-----", "[REDACTED]"),
        (r"AKIA[0-9A-Z]{16}", "[REDACTED]"),
        (rf"Bearer{WS}+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"),
        (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED]"),
        (r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,4}\b", "[REDACTED]"),
    ]
    if extended:
        rules += [
            (r"(?i)\b(code|pin|otp)\b([^0-9\n]{0,20})\d{4,8}\b", r"\1\2[REDACTED]"),
            (r"\b\d{16}\b", "[REDACTED]"),
        ]
    for pattern, replacement in rules:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


def stripped(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def latin1(x: str) -> str:
    """UTF-8 bytes of a text read as Latin-1."""
    u = "unicode(c)"
    return f"""array_to_string(list_transform(string_split({x}, ''), lambda c: CASE
      WHEN {u} < 128 THEN c
      WHEN {u} < 2048 THEN chr(192 + {u} // 64) || chr(128 + {u} % 64)
      WHEN {u} < 65536 THEN chr(224 + {u} // 4096) || chr(128 + {u} // 64 % 64) || chr(128 + {u} % 64)
      ELSE chr(240 + {u} // 262144) || chr(128 + {u} // 4096 % 64) || chr(128 + {u} // 64 % 64)
           || chr(128 + {u} % 64) END), '')"""


def sender_address(f: str) -> str:
    return f"lower(CASE WHEN regexp_matches({f}, '<[^>]+>') THEN regexp_extract({f}, '<([^>]+)>', 1) ELSE {f} END)"


def sender_name(f: str) -> str:
    display = trim(f"regexp_extract({f}, '^([^\\n\\r]+?){WS}*<', 1)")
    display = f"""regexp_replace(regexp_replace({display}, '^["'']', ''), '["'']$', '')"""
    return f"CASE WHEN {display} <> '' THEN {display} WHEN split_part({f}, '@', 1) <> '' THEN split_part({f}, '@', 1) ELSE {f} END"


MAIL = f"mail AS ({fx.view_sql('fx_mail')})"
PENDING = f"pending AS ({fx.view_sql('fx_pending')})"
FEED = f"feed AS ({fx.view_sql('fx_feed')})"
CALL = f"call AS ({fx.view_sql('fx_call')})"
NOTE = f"note AS ({fx.view_sql('fx_notification')})"
ATTEMPT = f"attempt AS ({fx.view_sql('fx_attempt')})"
ACCOUNT = f"account AS ({fx.view_sql('fx_account')})"
REQUEST = f"request AS ({fx.view_sql('fx_account_request')})"
PUSH = f"push AS ({fx.view_sql('fx_push')})"

RULED = f"""{MAIL}, ruled AS (SELECT *, CASE
    WHEN {sender_address('from_addr')} LIKE '%@yourcompany.com' THEN NULL
    WHEN label_csv LIKE '%CATEGORY_PROMOTIONS%' OR label_csv LIKE '%CATEGORY_SOCIAL%'
      OR label_csv LIKE '%SPAM%' THEN 'Ads'
    WHEN unsubscribe <> '' THEN 'Newsletter' END AS rule FROM mail)"""

SETTLED = f"""{RULED}, settled AS (SELECT *,
    CASE rule WHEN 'Ads' THEN 'Ignore' WHEN 'Newsletter' THEN 'Not Necessary' ELSE
      CASE doc_id % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' ELSE 'Low' END END AS priority,
    CASE WHEN rule IS NULL THEN 'Summary ' || doc_id ELSE left(subject, 80) END AS summary,
    coalesce(rule, 'Label' || (doc_id % 5)) AS label,
    CASE WHEN rule IS NULL THEN 'openrouter' ELSE 'rule' END AS method FROM ruled)"""

DIMENSION = """dim(priority, number, tag, emoji) AS (VALUES ('Critical', 5, 'rotating_light', '🔴'),
    ('High', 4, 'warning', '🟠'), ('Medium', 3, 'envelope', '🟡'), ('Low', 2, 'bell', '⚪'),
    ('Not Necessary', 1, 'muted_speaker', '⚫'))"""

ORACLES: dict[str, str] = {}

ORACLES["triage_summary"] = f"""WITH {RULED} SELECT
    CASE rule WHEN 'Ads' THEN 'Ignore' WHEN 'Newsletter' THEN 'Not Necessary' ELSE 'Medium' END AS priority,
    coalesce(rule, 'Other') AS label, CASE WHEN rule IS NULL THEN 'fallback' ELSE 'rule' END AS method,
    CASE rule WHEN 'Ads' THEN 'discard' ELSE 'queue' END AS route, count(*) AS n
  FROM ruled GROUP BY ALL"""

ORACLES["rule_verdicts"] = f"""WITH {RULED} SELECT id,
    CASE rule WHEN 'Ads' THEN 'Ignore' WHEN 'Newsletter' THEN 'Not Necessary' END AS priority,
    CASE WHEN rule IS NOT NULL THEN left(subject, 80) END AS summary, rule AS label,
    CASE WHEN rule IS NOT NULL THEN 'rule' END AS method FROM ruled"""

ORACLES["trusted_senders"] = f"""WITH {MAIL} SELECT id, from_addr FROM mail
  WHERE ends_with({sender_address('from_addr')}, '@yourcompany.com')
     OR {sender_address('from_addr')} = 'user7@plain.example'"""

ORACLES["trusted_senders_by_table"] = f"""WITH {MAIL}, entries AS (SELECT DISTINCT lower(CASE
      WHEN c_custkey % 2 = 0 THEN '@example' || c_custkey % 40 || '.com'
      ELSE 'User' || c_custkey % 40 || '@plain.example' END) AS entry FROM customer
    UNION SELECT '@yourcompany.com')
  SELECT id, from_addr, EXISTS (SELECT 1 FROM entries WHERE CASE WHEN entry LIKE '@%'
    THEN ends_with({sender_address('from_addr')}, entry)
    ELSE {sender_address('from_addr')} = entry END) AS trusted FROM mail"""

ORACLES["ignored_labels"] = f"""WITH {MAIL} SELECT id, label_csv FROM mail WHERE list_has_any(
    string_split(label_csv, ','), ['CATEGORY_PROMOTIONS', 'CATEGORY_SOCIAL', 'SPAM'])"""

ORACLES["newsletters"] = f"WITH {MAIL} SELECT id FROM mail WHERE coalesce(unsubscribe, '') <> ''"

ORACLES["routes"] = f"""WITH {SETTLED} SELECT id, priority, CASE priority WHEN 'Ignore' THEN 'discard'
    WHEN 'Critical' THEN 'immediate' ELSE 'queue' END AS route FROM settled"""

ORACLES["immediate_notifications"] = f"""WITH {SETTLED} SELECT id,
    '🔴 ' || {sender_name('from_addr')} || ': ' || left(subject, 60) AS title, summary AS message,
    5 AS priority, 'rotating_light' AS tags, 1 AS markdown FROM settled WHERE priority = 'Critical'"""

ORACLES["mailbox_actions"] = f"""WITH {SETTLED} SELECT id, 'AI/' || label AS add_labels,
    CASE priority WHEN 'Critical' THEN '' ELSE 'UNREAD' END AS remove_labels
  FROM settled WHERE priority <> 'Ignore'"""

ORACLES["processing_log"] = f"""WITH {SETTLED}, done AS (SELECT *, doc_id % 9 = 0 AS failed FROM settled)
  SELECT id, strftime(make_timestamp((received_at + doc_id % 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts,
    CASE WHEN failed THEN 'error' ELSE 'info' END AS level,
    CASE WHEN failed THEN 'email.process_error' ELSE 'email.processed' END AS event,
    id AS message_id, CASE WHEN NOT failed THEN priority END AS priority,
    CASE WHEN NOT failed THEN label END AS label, CASE WHEN NOT failed THEN method END AS method,
    CASE WHEN NOT failed THEN doc_id % 77 END AS duration_ms,
    CASE WHEN failed THEN 'bad: ' || repeat('part of ' || id || '; ', 30) END AS error FROM done"""

ORACLES["failure_alerts"] = f"""WITH {MAIL} SELECT id, '[SYSTEM] ' || left('bad: ' || repeat('part of ' || id || '; ', 30), 280) AS message,
    5 AS priority, 'rotating_light' AS tags FROM mail WHERE doc_id % 9 = 0"""

ORACLES["sender_fields"] = f"""WITH {MAIL} SELECT id, {sender_address('from_addr')} AS address,
    {sender_name('from_addr')} AS name, '{LINK}' || id AS link FROM mail"""

ORACLES["html_stripped"] = f"""SELECT page_id, md5({stripped('html')}) AS digest,
    length({stripped('html')}) AS n_chars FROM pages"""

for _name, _extended in (("text_redacted", False), ("text_redacted_extended", True)):
    ORACLES[_name] = f"""WITH {MAIL}, clean AS (SELECT id, {redacted('body', _extended)} AS text FROM mail)
      SELECT id, md5(text) AS digest, length(text) AS n_chars, left(text, 2048) AS body_text FROM clean"""

# A model answer is a whole JSON object, perhaps fenced, whose priority is one of six.
_CLEAN = trim(f"regexp_replace(regexp_replace(content, '(?i)^```json{WS}*', ''), '{WS}*```$', '')")
ANSWER = f"""{ATTEMPT}, cleaned AS (SELECT *, {_CLEAN} AS clean FROM attempt),
  typed AS (SELECT *, CASE WHEN json_valid(clean) AND json_type(clean) = 'OBJECT' THEN clean END AS j FROM cleaned),
  answer AS (SELECT message_id, rank, status,
    CASE WHEN good THEN j ->> '$.priority' END AS priority,
    CASE WHEN good THEN left(coalesce(j ->> '$.summary', ''), 120) END AS summary,
    CASE WHEN good THEN coalesce(nullif(left(regexp_replace(coalesce(j ->> '$.label', ''), '[^A-Za-z0-9]', '', 'g'), 30), ''), 'Other') END AS label
    FROM (SELECT *, coalesce(j ->> '$.priority' IN ('Critical', 'High', 'Medium', 'Low', 'Not Necessary', 'Ignore'), false) AS good FROM typed))"""

ORACLES["parsed_answers"] = f"WITH {ANSWER} SELECT message_id, rank, priority, summary, label FROM answer"

ORACLES["priority_dimension"] = f"""WITH {PENDING}, {DIMENSION} SELECT priority, count(*) AS n,
    any_value(number) AS number, any_value(tag) AS tag, any_value(emoji) AS emoji
  FROM pending JOIN dim USING (priority) GROUP BY priority"""

ORACLES["daily_arrivals"] = f"""SELECT strftime(ts, '%Y-%m-%d') AS day,
    epoch_ms(date_trunc('month', ts)::TIMESTAMP) AS month_start, count(*) AS n FROM events GROUP BY ALL"""

# --- sources ---

_ENVELOPE = f"""{PUSH}, opened AS (SELECT *, json_valid(body) AS is_json,
    CASE WHEN json_valid(body) THEN body -> '$.message' END AS message FROM push),
  decoded AS (SELECT *, TRY(decode(from_base64(message ->> '$.data'))) AS payload FROM opened),
  checked AS (SELECT *, CASE WHEN coalesce(json_valid(payload), false) THEN payload END AS p FROM decoded),
  envelope AS (SELECT event_id, message ->> '$.messageId' AS push_id, p ->> '$.emailAddress' AS account,
    p ->> '$.historyId' AS history_id, CASE WHEN NOT is_json THEN 'bad_json'
      WHEN message IS NULL THEN 'no_message' WHEN p IS NULL THEN 'bad_envelope'
      WHEN p ->> '$.historyId' IS NULL THEN 'no_history_id'
      WHEN NOT regexp_matches(p ->> '$.emailAddress', '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'bad_account'
      END AS reject_reason FROM checked)"""

ORACLES["push_envelopes"] = f"WITH {_ENVELOPE} SELECT event_id, push_id, account, history_id, reject_reason FROM envelope"
ORACLES["push_quarantine"] = f"""WITH {_ENVELOPE} SELECT reject_reason, count(*) AS n FROM envelope
  WHERE reject_reason IS NOT NULL GROUP BY reject_reason"""

_BOX = f"""{FEED}, box AS (SELECT account, box, max(entry_id) AS last, max(entry_id) // 2 AS half FROM feed GROUP BY ALL),
  plan AS (SELECT account, last, CASE WHEN box IN (15, 16, 17, 19) THEN 'fallback' ELSE 'feed' END AS mode,
    CASE WHEN box IN (15, 16, 19) THEN 1 ELSE half END AS start_id FROM box),
  mailbox AS (SELECT account, message_id, max(received_at) AS received_at FROM feed WHERE message_id IS NOT NULL GROUP BY ALL),
  scanned AS (SELECT account, message_id FROM feed JOIN plan USING (account)
    WHERE mode = 'feed' AND entry_id > start_id AND message_id IS NOT NULL),
  fallen AS (SELECT account, message_id FROM mailbox JOIN plan USING (account)
    WHERE mode = 'fallback' AND received_at > {fx.NOW_MS - DAY}
    QUALIFY row_number() OVER (PARTITION BY account ORDER BY received_at DESC, message_id) <= 10)"""
_SEEN = "seen AS (SELECT message_id, min(received_at) AS processed_at FROM feed WHERE event_type = 'purchase' GROUP BY ALL)"

ORACLES["feed_plan"] = f"WITH {_BOX} SELECT account, mode, start_id::VARCHAR AS start_id FROM plan"
ORACLES["feed_scan"] = f"WITH {_BOX} SELECT account, message_id FROM scanned"
ORACLES["feed_cursors"] = f"WITH {_BOX} SELECT account, last::VARCHAR AS cursor FROM plan"
ORACLES["feed_fallback"] = f"WITH {_BOX} SELECT account, message_id FROM fallen"
ORACLES["feed_incoming"] = f"""WITH {_BOX}, {_SEEN} SELECT account, message_id FROM (FROM scanned UNION FROM fallen)
  WHERE message_id NOT IN (SELECT message_id FROM seen)"""
ORACLES["account_syncs"] = f"""WITH {_BOX}, {NOTE} SELECT event_id, note.account, half::VARCHAR AS cursor
  FROM note LEFT JOIN (SELECT * FROM box WHERE box NOT IN (15, 16, 19)) b ON note.account = b.account"""

_BROKEN = "doc_id % 50 = 49"
ORACLES["message_fields"] = f"""WITH {MAIL}, m AS (SELECT *, {_BROKEN} AS broken FROM mail) SELECT doc_id,
    CASE WHEN NOT broken THEN id END AS id, CASE WHEN NOT broken THEN 't' || doc_id END AS thread_id,
    CASE WHEN broken THEN '' ELSE from_addr END AS from_addr, CASE WHEN broken THEN '' ELSE subject END AS subject,
    CASE WHEN NOT broken THEN snippet END AS snippet, '' AS date,
    CASE WHEN broken THEN '' ELSE label_csv END AS label_csv,
    CASE WHEN NOT broken THEN unsubscribe END AS unsubscribe, CASE WHEN broken THEN 1 ELSE 14 END AS n_nodes,
    CASE WHEN broken THEN 'bad_message' END AS reject_reason FROM m"""

_HTML = "('<p>' || subject || '</p>&amp; ' || body)"
_BODY = f"CASE WHEN {_BROKEN} THEN '' WHEN doc_id % 2 = 0 THEN {stripped(_HTML)} ELSE body END"
_BODY_1 = f"CASE WHEN {_BROKEN} THEN '' WHEN doc_id % 2 = 0 THEN {stripped(latin1(_HTML))} ELSE {latin1('body')} END"
ORACLES["message_bodies"] = f"WITH {MAIL} SELECT doc_id, md5(left({redacted(_BODY_1)}, 2048)) AS digest FROM mail"
ORACLES["message_bodies_utf8"] = f"WITH {MAIL} SELECT doc_id, md5(left({redacted(_BODY)}, 2048)) AS digest FROM mail"

def _literal(x: str) -> str:
    x = f"regexp_replace({x}, '[^\\x00-\\x7F]+', ' ', 'g')"
    for special, plain in fx.PDF_SPECIAL:
        x = f"replace({x}, '{special}', '{plain}')"
    return x


NODES = f"""{MAIL}, part(path, mime_type, filename, attachment_id, i) AS (VALUES
    ('', 'multipart/mixed', NULL, NULL, -1), ('0', 'text/plain', NULL, NULL, -2),
    ('1', 'multipart/alternative', NULL, NULL, -1), ('1.0', 'text/html', NULL, NULL, -3),
    ('1.1', 'text/plain', NULL, NULL, -4), ('2', 'text/plain', 'note.txt', NULL, -4),
    ('3', 'application/pdf', 'a.pdf', 'pdf', -5), ('4', 'image/png', NULL, NULL, 0),
    ('5', 'image/png', NULL, 'img1', 1), ('6', 'image/png', NULL, NULL, 2), ('7', 'image/png', NULL, 'img3', 3),
    ('8', 'image/png', NULL, NULL, 4), ('9', 'image/png', NULL, 'img5', 5), ('10', 'image/png', NULL, NULL, 6)),
  node AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND i IN (2, 3) THEN '<same@cid>' END AS content_id,
    CASE i WHEN -1 THEN NULL WHEN -2 THEN 0 WHEN -3 THEN length({_HTML}) WHEN -4 THEN length(body)
      WHEN -5 THEN 1000 ELSE CASE WHEN doc_id % 13 = i THEN 1048577 ELSE 1048576 END END AS size,
    (i = -1)::INT AS is_container,
    {_literal('body')} AS literal
    FROM mail CROSS JOIN part WHERE NOT ({_BROKEN})),
  filled AS (SELECT *, CASE WHEN size > 1048576 THEN NULL
      WHEN i = -3 AND doc_id % 2 = 0 THEN {_HTML} WHEN i = -4 THEN body
      WHEN i >= 0 AND i % 2 = 0 THEN 'image ' || i || ' of ' || doc_id
      WHEN doc_id % 9 = 0 THEN NULL
      WHEN i = -5 THEN '%PDF-1.4 stream' || chr(10) || '(BT (hidden) ET endstream BT (' || literal || ') Tj <48692121> ET'
      WHEN i = 3 AND doc_id % 11 = 0 THEN NULL
      WHEN i > 0 THEN 'image ' || i || ' of ' || doc_id END AS content FROM node)"""

ORACLES["mime_parts"] = f"""WITH {NODES} SELECT id AS message_id, path,
    CASE WHEN i >= 0 THEN 'image/png' ELSE mime_type END AS mime_type, filename, content_id, size,
    attachment_id, is_container FROM node"""
ORACLES["first_content_ids"] = f"""WITH {NODES} SELECT id, path FROM node
  WHERE is_container = 0 AND NOT (i = 3 AND content_id IS NOT NULL)"""
ORACLES["attachment_bytes"] = f"""WITH {NODES} SELECT id AS message_id, path, md5(content) AS digest
  FROM filled WHERE is_container = 0"""

ORACLES["message_images"] = f"""WITH {NODES}, usable AS (SELECT id, i, content FROM filled
    WHERE i >= 0 AND content IS NOT NULL AND NOT (i = 3 AND content_id IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 5)
  SELECT m.id, coalesce(string_agg('data:image/png;base64,' || base64(encode(content)), ' ' ORDER BY i), '') AS images
  FROM (SELECT DISTINCT id FROM node) m LEFT JOIN usable u ON m.id = u.id GROUP BY m.id"""

_PDF_PIECE = f"CASE WHEN length({trim('literal')}) > 1 THEN literal || ' Hi!!' ELSE 'Hi!!' END"
_PDF_TEXT = trim(f"regexp_replace({_PDF_PIECE}, '{WS}+', ' ', 'g')")
ORACLES["pdf_texts"] = f"""WITH {MAIL}, drawn AS (SELECT id, {_literal('body')} AS literal FROM mail WHERE doc_id % 9 <> 0)
  SELECT id AS message_id, left({_PDF_TEXT}, 2000) AS text FROM drawn"""
ATTACHED = f"""{NODES}, note AS (SELECT id, left({trim(redacted('body'))}, 2000) AS t FROM node WHERE path = '2'),
  pdf AS (SELECT id, CASE WHEN content IS NOT NULL THEN {_PDF_TEXT} END AS t FROM filled WHERE path = '3'),
  budget AS (SELECT id, note.t AS t1, CASE WHEN length(note.t) >= 2000 THEN ''
      ELSE coalesce({trim(redacted('left(pdf.t, 2000 - length(note.t)::INT)'))}, '') END AS t2
    FROM note JOIN pdf USING (id)),
  attached AS (SELECT id, t1 || CASE WHEN t1 <> '' AND t2 <> '' THEN chr(10) ELSE '' END || t2 AS text FROM budget)"""
ORACLES["attachment_text"] = f"WITH {ATTACHED} SELECT id, text FROM attached"

_ATTACHED_LINE = f"left({trim('text')}, 1000)"
_PROMPT = f"""'From: ' || from_addr || chr(10) || 'Subject: ' || subject || chr(10) || 'Body: '
      || left(CASE WHEN {trim('b')} <> '' THEN {trim('b')} ELSE snippet END, 1800)
      || CASE WHEN {_ATTACHED_LINE} <> '' THEN chr(10) || 'Attachment text: ' || {_ATTACHED_LINE} ELSE '' END"""
_PROMPTED = f"""{ATTACHED}, count AS (SELECT id, least(5, count(*) FILTER (
      WHERE i >= 0 AND content IS NOT NULL AND NOT (i = 3 AND content_id IS NOT NULL))) AS images FROM filled GROUP BY id),
  body AS (SELECT id, from_addr, subject, snippet, left({redacted(_BODY)}, 2048) AS b FROM mail),
  prompted AS (SELECT id, text, images, {_PROMPT} AS prompt FROM attached JOIN count USING (id) JOIN body USING (id))"""
ORACLES["prompts"] = f"""WITH {_PROMPTED} SELECT id AS message_id, prompt,
    CASE WHEN images > 0 THEN 'google/gemini-2.0-flash-001' ELSE 'openrouter/auto' END AS model,
    1 + images AS n_parts FROM prompted"""

# --- scoring and limits ---

RESOLVED = f"""{ANSWER}, admitted AS (SELECT a.* FROM answer a LEFT JOIN answer f
      ON f.message_id = a.message_id AND f.rank = a.rank - 1 AND a.rank IN (1, 3)
    WHERE a.status = 200 AND a.priority IS NOT NULL AND NOT coalesce(f.status BETWEEN 400 AND 499, false)),
  first AS (SELECT * FROM admitted QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY rank) = 1),
  resolved AS (SELECT m.message_id, coalesce(priority, 'Medium') AS priority,
      coalesce(summary, 'Classification unavailable') AS summary, coalesce(label, 'Other') AS label,
      CASE WHEN rank < 4 THEN 'openrouter' WHEN rank = 4 THEN 'workers-ai' ELSE 'fallback' END AS method
    FROM (SELECT DISTINCT message_id FROM attempt) m LEFT JOIN first f USING (message_id))"""
ORACLES["resolved_attempts"] = f"WITH {RESOLVED} SELECT * FROM resolved"

ORACLES["classified_mail"] = f"""WITH {RESOLVED}, {RULED} SELECT id,
    CASE WHEN rule = 'Ads' THEN 'Ignore' WHEN rule IS NOT NULL THEN 'Not Necessary' ELSE coalesce(r.priority, 'Medium') END AS priority,
    CASE WHEN rule IS NOT NULL THEN left(subject, 80) ELSE coalesce(r.summary, 'Classification unavailable') END AS summary,
    coalesce(rule, r.label, 'Other') AS label,
    CASE WHEN rule IS NOT NULL THEN 'rule' ELSE coalesce(r.method, 'fallback') END AS method
  FROM ruled LEFT JOIN resolved r ON r.message_id = 'm' || doc_id"""

_PROMPT_BODY = f"lower('From: ' || from_addr || chr(10) || 'Subject: ' || subject || chr(10) || 'Body: ' || left({trim('body')}, 1800))"
ORACLES["keyword_scores"] = f"""WITH {RULED}, p AS (SELECT id, {_PROMPT_BODY} AS t FROM ruled WHERE rule IS NULL)
  SELECT id AS message_id, CASE WHEN t LIKE '%verification code%' THEN 'Critical'
      WHEN t LIKE '%ssn%' OR t LIKE '%card%' THEN 'High' WHEN t LIKE '%bearer%' THEN 'Medium' ELSE 'Low' END AS priority,
    'Keyword' AS label, 'openrouter' AS method FROM p"""

ORACLES["scored_chain"] = f"""WITH {RULED}, p AS (SELECT id, doc_id AS n, n % 6 < 4 AS b1, n % 4 < 2 AS b2,
    n % 5 = 0 AS b3 FROM ruled WHERE rule IS NULL)
  SELECT id AS message_id, CASE WHEN b1 AND b2 AND b3 THEN 'Medium' ELSE 'High' END AS priority,
    CASE WHEN NOT b1 THEN 'openrouter/auto' WHEN NOT b2 THEN 'deepseek/deepseek-v4-flash'
      WHEN NOT b3 THEN '@cf/meta/llama-3.3-70b-instruct-fp8-fast' ELSE 'Classification unavailable' END AS summary,
    CASE WHEN b1 AND b2 AND b3 THEN 'Other' ELSE 'Chain' END AS label,
    CASE WHEN b1 AND b2 AND b3 THEN 'fallback' WHEN b1 AND b2 THEN 'workers-ai' ELSE 'openrouter' END AS method,
    CASE WHEN NOT b1 THEN 1 ELSE CASE WHEN n % 6 = 0 THEN 1 ELSE 2 END
      + CASE WHEN NOT b2 THEN 1 WHEN n % 4 = 0 THEN 2 ELSE 3 END END::BIGINT AS n_tries FROM p"""

ORACLES["daily_classifications"] = f"""WITH {RESOLVED}, started AS (
    SELECT 'm' || (event_id // 5) AS message_id, min(ts) AS ts FROM events GROUP BY ALL)
  SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM resolved JOIN started USING (message_id)
  WHERE method <> 'fallback' GROUP BY ALL"""

ORACLES["quota_denials"] = f"""WITH {CALL}, counted AS (SELECT id, ts // {DAY} AS day,
    count(*) FILTER (WHERE ok) OVER (PARTITION BY ts // {DAY} ORDER BY ts, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM call)
  SELECT id, day FROM counted WHERE before >= 100"""

# The fold as it is described: one call after the other.
_ELEMENT = """{'id': id, 'ts': ts, 'ok': ok, 'open': 0::BIGINT, 'fails': 0::BIGINT, 'last': 0::BIGINT,
    'day': -1::BIGINT, 'used': 0::BIGINT, 'result': ''}"""


def _fold(quota: int, ttl: int) -> str:
    day = f"x.ts // {DAY}"
    used = f"(CASE WHEN a.day = {day} THEN a.used ELSE 0 END)"
    is_open = "x.ts < a.open"
    over = f"{used} >= {quota}"
    count = f"(CASE WHEN a.fails > 0 AND x.ts - a.last < {ttl} THEN a.fails + 1 ELSE 1 END)"
    skip = f"({is_open} OR {over})"
    return f"""{{'id': x.id, 'ts': x.ts, 'ok': x.ok,
      'open': CASE WHEN {skip} OR x.ok OR {count} < 3 THEN a.open ELSE x.ts + {ttl} END,
      'fails': CASE WHEN {skip} THEN a.fails WHEN x.ok OR {count} >= 3 THEN 0 ELSE {count} END,
      'last': CASE WHEN {skip} OR x.ok THEN a.last ELSE x.ts END,
      'day': {day}, 'used': {used} + (NOT {skip} AND x.ok)::BIGINT,
      'result': a.result || CASE WHEN {is_open} THEN 'o' WHEN {over} THEN 'q' WHEN x.ok THEN 's'
        WHEN {count} >= 3 THEN 't' ELSE 'f' END}}"""


def _folded(quota: int, ttl: int = 300_000, calls: str = "call", first_id: str = "-1::BIGINT") -> str:
    return f"""listed AS (SELECT list({_ELEMENT} ORDER BY ts, id) AS xs FROM {calls}),
      done AS (SELECT xs, list_reduce(xs, lambda a, x: {_fold(quota, ttl)}, {{'id': {first_id}, 'ts': 0::BIGINT,
        'ok': true, 'open': 0::BIGINT, 'fails': 0::BIGINT, 'last': 0::BIGINT, 'day': -1::BIGINT,
        'used': 0::BIGINT, 'result': ''}}).result AS result FROM listed),
      folded AS (SELECT unnest(list_transform(xs, lambda x: x.id)) AS id, unnest(string_split(result, '')) AS r FROM done)"""


ORACLES["breaker_calls"] = f"""WITH {CALL}, {_folded(10**9)} SELECT id, (r <> 'o')::INT AS attempted, (r = 't')::INT AS tripped FROM folded"""
ORACLES["limited_calls"] = f"""WITH {CALL}, {_folded(100)} SELECT id, CASE r WHEN 'o' THEN 'open' WHEN 'q' THEN 'quota'
    WHEN 's' THEN 'ok' ELSE 'failed' END AS outcome FROM folded"""

_DUE = f"""{RESOLVED}, due AS (SELECT message_id AS id, epoch_us(min(ts)) // 1000 AS ts, any_value(method) <> 'fallback' AS ok
    FROM resolved JOIN events ON message_id = 'm' || (event_id // 5) GROUP BY message_id)"""
ORACLES["limited_verdicts"] = f"""WITH {_DUE}, {_folded(20, 7_200_000, 'due', "''")}
  SELECT message_id, CASE WHEN r IN ('o', 'q') THEN 'Medium' ELSE priority END AS priority,
    CASE WHEN r IN ('o', 'q') THEN 'Classification unavailable' ELSE summary END AS summary,
    CASE WHEN r IN ('o', 'q') THEN 'Other' ELSE label END AS label,
    CASE WHEN r IN ('o', 'q') THEN 'fallback' ELSE method END AS method
  FROM resolved JOIN folded ON id = message_id"""

# --- queue ---

ORACLES["queue_inserts"] = f"""WITH {SETTLED}, {PENDING}
  SELECT id, from_addr, subject, summary, priority, received_at, sent_at FROM pending
  UNION ALL SELECT 'e' || doc_id * 20, from_addr, subject, summary, priority, received_at, NULL FROM settled
  WHERE priority NOT IN ('Critical', 'Ignore') AND 'e' || doc_id * 20 NOT IN (SELECT id FROM pending)"""

_PLACED = f"""{PENDING}, placed AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY received_at, id) AS pos
    FROM pending WHERE sent_at IS NULL)"""
ORACLES["queue_oldest"] = f"WITH {_PLACED} SELECT id, priority, pos, (pos - 1) // 20 AS chunk FROM placed WHERE pos <= 100"
ORACLES["queue_chunks"] = f"WITH {_PLACED} SELECT id, priority, pos, (pos - 1) // 20 AS chunk FROM placed"

_SCHEDULE = f"""schedule(priority, period, phase) AS (VALUES ('High', 1800000, 0), ('Medium', 3600000, 0),
    ('Low', 7200000, 0), ('Not Necessary', {DAY}, 61200000))"""
ORACLES["flush_windows"] = """WITH e AS (SELECT ts, CASE WHEN event_type IN ('error', 'signup') THEN 'High'
      WHEN event_type = 'purchase' THEN 'Medium' WHEN event_type = 'click' THEN 'Low' ELSE 'Not Necessary' END AS priority FROM events)
  SELECT priority, epoch_ms(CASE priority WHEN 'High' THEN time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE
      WHEN 'Medium' THEN time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
      WHEN 'Low' THEN time_bucket(INTERVAL 2 HOUR, ts) + INTERVAL 2 HOUR
      ELSE time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01 17:00:00') + INTERVAL 1 DAY END) AS flush_at,
    count(*) AS n FROM e GROUP BY ALL"""


def _served(cap: int) -> str:
    """Rows served up to each tick, from arrivals alone, then a range join."""
    return f"""{PENDING}, {_SCHEDULE}, arrived AS (SELECT *, (received_at - phase) // period AS tick,
        row_number() OVER (PARTITION BY priority ORDER BY received_at, id) AS pos FROM pending JOIN schedule USING (priority)),
      span AS (SELECT priority, min(tick) AS lo, max(tick) + count(*) // {cap} + 2 AS hi, any_value(period) AS period,
        any_value(phase) AS phase FROM arrived GROUP BY priority),
      ticks AS (SELECT priority, period, phase, unnest(range(lo, hi)) AS tick, lo FROM span),
      counted AS (SELECT t.*, (SELECT count(*) FROM arrived a WHERE a.priority = t.priority AND a.tick = t.tick) AS n FROM ticks t),
      total AS (SELECT *, tick - lo + 1 AS t, sum(n) OVER (PARTITION BY priority ORDER BY tick) AS a FROM counted),
      served AS (SELECT *, least({cap} * t, {cap} * t + min(a - {cap} * t) OVER (PARTITION BY priority ORDER BY tick)) AS s FROM total),
      stepped AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY priority ORDER BY tick), 0) AS before FROM served),
      assigned AS (SELECT arrived.*, stepped.tick AS sent_tick, (stepped.tick + 1) * stepped.period + stepped.phase AS flush_at
        FROM arrived JOIN stepped ON arrived.priority = stepped.priority AND before < pos AND pos <= s)"""


ORACLES["flush_assignment"] = f"WITH {_served(2)} SELECT id, priority, pos, sent_tick, flush_at FROM assigned"

ORACLES["mark_sent"] = f"""WITH {PENDING} SELECT id, CASE WHEN priority = 'Low' THEN {fx.NOW_MS} ELSE sent_at END AS sent_at FROM pending"""
_SINCE = fx.NOW_MS - 10 * DAY
ORACLES["replayed"] = f"""WITH {PENDING} SELECT id, CASE WHEN received_at >= {_SINCE} OR sent_at >= {_SINCE} THEN NULL
    ELSE sent_at END AS sent_at FROM pending"""
ORACLES["replayed_rows"] = f"""WITH {PENDING} SELECT count(*) AS rows_reset FROM pending
  WHERE received_at >= {_SINCE} OR sent_at >= {_SINCE}"""
ORACLES["retained_pending"] = f"""WITH {PENDING} SELECT id FROM pending EXCEPT
  SELECT id FROM pending WHERE sent_at IS NOT NULL AND sent_at < {fx.NOW_MS - DAY}"""
ORACLES["retained_processed"] = f"""WITH {FEED}, {_SEEN} SELECT message_id, processed_at FROM seen
  WHERE NOT processed_at < {fx.NOW_MS - 2 * DAY}"""
ORACLES["processed_inserts"] = f"""WITH {FEED}, {_SEEN} SELECT message_id, 0 AS processed_at FROM seen
  UNION ALL SELECT message_id, min(received_at) FROM feed
  WHERE message_id IS NOT NULL AND message_id NOT IN (SELECT message_id FROM seen) GROUP BY message_id"""

_KEYED = f"""{NOTE}, change AS (SELECT 'gmail:history_id:' || account AS key, history_id AS value, ts AS updated_at FROM note),
  old AS (SELECT DISTINCT key, 'old' AS value, 1 AS updated_at FROM change WHERE key < 'gmail:history_id:box4')"""
ORACLES["state_upserts"] = f"""WITH {_KEYED} SELECT key, arg_max(value, updated_at) AS value, max(updated_at) AS updated_at
  FROM (FROM old UNION ALL FROM change) GROUP BY key"""
ORACLES["state_inserts"] = f"""WITH {_KEYED} FROM old UNION ALL SELECT key, arg_min(value, updated_at), min(updated_at)
  FROM change WHERE key NOT IN (SELECT key FROM old) GROUP BY key"""
ORACLES["state_lookups"] = f"""WITH {_KEYED}, {FEED}, asked AS (SELECT 'gmail:history_id:' || account AS key FROM feed)
  SELECT asked.key, old.value, count(*) AS n FROM asked LEFT JOIN old USING (key) GROUP BY ALL"""

# --- digests ---


def _digests(flush: str, by: str) -> str:
    """``flush`` has by, chunk, pos, id, summary, from_addr."""
    return f"""named AS (SELECT *, {sender_name('from_addr')} AS name FROM {flush}),
      grouped AS (SELECT {by}, chunk, name, min(pos) AS first_pos, count(*) AS n,
          string_agg(id, ',' ORDER BY pos) AS ids, string_agg('  - ' || summary, chr(10) ORDER BY pos) AS lines,
          string_agg('[link →]({LINK}' || id || ')', ' ' ORDER BY pos) AS links, min_by(summary, pos) AS summary
        FROM named GROUP BY {by}, chunk, name),
      bullets AS (SELECT *, row_number() OVER (PARTITION BY {by}, chunk ORDER BY first_pos) AS k,
          count(*) OVER (PARTITION BY {by}, chunk) AS names,
          CASE n WHEN 1 THEN '- **' || name || '**: ' || summary || ' ' || links
            ELSE '- **' || name || '** (' || n || '):' || chr(10) || lines || chr(10) || '  ' || links END AS bullet FROM grouped),
      digest AS (SELECT {by}, chunk, sum(n)::BIGINT AS n,
          '[' || sum(n)::BIGINT || CASE WHEN sum(n) > 1 THEN ' emails] ' ELSE ' email] ' END
            || string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 4)
            || CASE WHEN any_value(names) > 4 THEN ' +' || (any_value(names) - 4) || ' more' ELSE '' END AS title,
          string_agg(bullet, chr(10) || chr(10) ORDER BY k) AS message FROM bullets GROUP BY {by}, chunk)"""


_FLUSH = f"{_PLACED}, flush AS (SELECT *, (pos - 1) // 20 AS chunk FROM placed WHERE pos <= 100)"
ORACLES["digest_groups"] = f"""WITH {_FLUSH}, {_digests('flush', 'priority')}
  SELECT priority, chunk, name, first_pos, n, ids FROM grouped"""
ORACLES["digest_rows"] = f"""WITH {_FLUSH}, {_digests('flush', 'priority')}, {DIMENSION}
  SELECT priority, chunk, n, title, message, number AS priority_number, tag AS tags FROM digest JOIN dim USING (priority)"""
ORACLES["digest_history"] = f"""WITH {_served(100)}, flush AS (SELECT *, (row_number() OVER (PARTITION BY priority, sent_tick ORDER BY pos) - 1) // 20 AS chunk FROM assigned),
  {_digests('flush', 'priority, sent_tick')}, {DIMENSION}
  SELECT priority, sent_tick, chunk, n, title, message, number AS priority_number, tag AS tags FROM digest JOIN dim USING (priority)"""
ORACLES["deliveries"] = f"""WITH {_FLUSH}, {_digests('flush', 'priority')}, {DIMENSION}
  SELECT chunk, title, number AS priority, CASE number WHEN 5 THEN 10 WHEN 4 THEN 8 WHEN 3 THEN 5 ELSE number END AS server_priority,
    'text/markdown' AS content_type FROM digest JOIN dim USING (priority)"""
ORACLES["delivery_outcomes"] = """SELECT event_id // 7 AS payload_id,
    max((event_type IN ('click', 'purchase') AND event_id % 7 <= 3)::INT) AS delivered FROM events GROUP BY ALL"""
ORACLES["delivered_marks"] = f"""WITH {_FLUSH} SELECT id, CASE WHEN id IN (SELECT id FROM flush WHERE chunk <> 1)
    THEN {fx.NOW_MS} ELSE sent_at END AS sent_at FROM pending"""
ORACLES["label_ids"] = f"""WITH {SETTLED} SELECT id, account, label, CASE WHEN label IN ('Label1', 'Label3')
    THEN 'known-AI/' || label
    ELSE 'Label_' || left(sha256(account || chr(0) || 'AI/' || label), 16) END AS label_id FROM settled"""

# --- statistics and accounts ---

ORACLES["processed_counts"] = f"""WITH {FEED}, {_SEEN} SELECT count(*) FILTER (WHERE processed_at > {fx.NOW_MS - DAY}) AS processed_today,
    count(*) FILTER (WHERE processed_at > epoch_ms(TIMESTAMP '2024-01-01')) AS processed_month FROM seen"""
ORACLES["pending_counts"] = f"""WITH {PENDING} SELECT p.priority, count(pending.id) AS n
  FROM (VALUES ('High'), ('Medium'), ('Low'), ('Not Necessary')) p(priority)
  LEFT JOIN pending ON CASE pending.priority WHEN 'Low' THEN 'Medium' ELSE pending.priority END = p.priority
    AND sent_at IS NULL GROUP BY p.priority"""
ORACLES["stored_queue"] = f"""WITH {PENDING} SELECT id, from_addr, subject, summary, priority, received_at, sent_at FROM pending"""
ORACLES["configured_rules"] = f"""WITH {MAIL}, listed AS (SELECT DISTINCT c_custkey % 20 AS k FROM customer),
  trusted AS (SELECT DISTINCT id FROM mail JOIN listed ON CASE WHEN k < 10
    THEN {sender_address('from_addr')} LIKE '%@example' || k || '.com'
    ELSE {sender_address('from_addr')} = 'user' || k || '@plain.example' END),
  ruled AS (SELECT id, CASE WHEN id IN (SELECT id FROM trusted) THEN NULL WHEN label_csv LIKE '%SPAM%' THEN 'Ads'
    WHEN unsubscribe <> '' THEN 'Newsletter' END AS label FROM mail)
  SELECT id, CASE label WHEN 'Ads' THEN 'Ignore' WHEN 'Newsletter' THEN 'Not Necessary' END AS priority, label FROM ruled"""
ORACLES["recent_pending"] = f"""WITH {PENDING} SELECT id, from_addr, subject, priority, received_at, sent_at FROM pending
  ORDER BY received_at DESC, id LIMIT 30"""
ORACLES["recent_processed"] = f"""WITH {FEED}, {_SEEN} SELECT * FROM seen ORDER BY processed_at DESC, message_id LIMIT 30"""
ORACLES["recent_history"] = f"""WITH {NOTE} SELECT history_id, min(ts) AS processed_at FROM note GROUP BY ALL
  ORDER BY processed_at DESC, history_id LIMIT 10"""
_VALID = r"regexp_matches(lower(trim(email)), '^[^\s@]+@[^\s@]+\.[^\s@]+$')"
ORACLES["accounts_normalised"] = f"WITH {REQUEST} SELECT added_at, lower(trim(email)) AS email, {_VALID}::INT AS valid FROM request"
ORACLES["accounts_added"] = f"""WITH {REQUEST}, {ACCOUNT}, known AS (SELECT email, added_at FROM account WHERE email <> '__primary__')
  FROM known UNION ALL SELECT lower(trim(email)) AS email, min(added_at) FROM request
  WHERE {_VALID} AND lower(trim(email)) NOT IN (SELECT email FROM known) GROUP BY 1"""
ORACLES["accounts_removed"] = f"""WITH {REQUEST}, {ACCOUNT} SELECT email, added_at FROM account WHERE email <> '__primary__'
  AND email NOT IN (SELECT lower(trim(email)) FROM request)"""
ORACLES["accounts_listed"] = f"""WITH {ACCOUNT} SELECT email, CASE WHEN nation < 10 THEN key * 10 END AS watch_expiry,
    CASE WHEN nation > 5 THEN key + 7 END AS last_webhook FROM account WHERE email <> '__primary__'"""

# --- streams ---

ORACLES["stream_notifications"] = f"""WITH {_ENVELOPE} SELECT DISTINCT account, history_id FROM envelope
  WHERE reject_reason IS NULL"""
ORACLES["stream_messages"] = f"WITH {FEED} SELECT DISTINCT message_id FROM feed WHERE message_id IS NOT NULL"
ORACLES["stream_flush_windows"] = f"SELECT *, 0 AS n_late FROM ({ORACLES['flush_windows']})"
ORACLES["stream_limited_calls"] = ORACLES["limited_calls"]
ORACLES["stream_cursors"] = f"""WITH {_KEYED} SELECT key, arg_max(value, updated_at) AS value,
  max(updated_at) AS updated_at FROM change GROUP BY key"""

# What the rules say, apart from the mail they are about.
_RULES = RULED[RULED.index("ruled AS"):]
ORACLES["stream_triage"] = f"""WITH {_PROMPTED}, {_RULES},
  p AS (SELECT ruled.*, text, images, lower(prompt) AS t FROM ruled LEFT JOIN prompted USING (id)),
  scored AS (SELECT *, CASE WHEN {_BROKEN} THEN NULL WHEN rule = 'Ads' THEN 'Ignore' WHEN rule IS NOT NULL THEN 'Not Necessary'
      WHEN t LIKE '%verification code%' THEN 'Critical'
      WHEN t LIKE '%ssn%' OR t LIKE '%card%' THEN 'High' WHEN t LIKE '%bearer%' THEN 'Medium' ELSE 'Low' END AS priority FROM p)
  SELECT id, priority, CASE WHEN priority IS NULL THEN 'quarantine' WHEN priority = 'Ignore' THEN 'discard'
      WHEN priority = 'Critical' THEN 'immediate' ELSE 'queue' END AS route,
    CASE WHEN NOT ({_BROKEN}) THEN md5(text) END AS attached, CASE WHEN NOT ({_BROKEN}) THEN images END AS n_images,
    CASE WHEN priority NOT IN ('Ignore', 'Critical') THEN 1 END AS queued,
    CASE WHEN priority = 'Critical' THEN '🔴 ' || {sender_name('from_addr')} || ': ' || left(subject, 60) END AS title FROM scored
  UNION ALL SELECT id, NULL, 'duplicate', NULL, NULL, NULL, NULL FROM scored WHERE doc_id % 7 = 0 AND NOT ({_BROKEN})"""

ORACLES["stream_deliveries"] = f"""WITH {_PLACED}, {CALL}, delivered AS (SELECT CASE WHEN id % 3 = 0 THEN 'High' ELSE 'Low' END AS priority,
    id % 5 AS chunk, ts, (ts - min(ts) OVER ()) // ((max(ts) OVER () - min(ts) OVER ()) // 3 + 1) AS part, ok FROM call),
  marks AS (SELECT priority, chunk, part, min(ts) AS sent FROM delivered WHERE ok AND chunk <> 2 GROUP BY ALL),
  last AS (SELECT priority, chunk, max(sent) AS sent FROM marks GROUP BY ALL),
  flush AS (SELECT id, priority, (pos - 1) // 20 AS chunk FROM placed WHERE pos <= 100)
  SELECT pending.id, coalesce(last.sent, pending.sent_at) AS sent_at FROM pending
  LEFT JOIN flush USING (id) LEFT JOIN last ON last.priority = flush.priority AND last.chunk = flush.chunk"""

ORACLES["stream_digests"] = ORACLES["digest_history"]
ORACLES["stream_digest_marks"] = f"""WITH {_served(100)}, flush AS (SELECT *,
    (row_number() OVER (PARTITION BY priority, sent_tick ORDER BY pos) - 1) // 20 AS chunk FROM assigned)
  SELECT id, CASE WHEN chunk <> 1 THEN flush_at + chunk * 1000 END AS sent_at,
    CASE WHEN chunk <> 1 THEN 'sent' ELSE 'waiting' END AS state FROM flush"""

ORACLES["labelled_actions"] = f"""WITH {SETTLED} SELECT id, CASE WHEN label IN ('Label1', 'Label3') THEN 'known-AI/' || label
    ELSE 'Label_' || left(sha256(account || chr(0) || 'AI/' || label), 16) END AS add_labels,
    CASE priority WHEN 'Critical' THEN '' ELSE 'UNREAD' END AS remove_labels
  FROM settled WHERE priority <> 'Ignore'"""
ORACLES["server_bodies"] = f"""WITH {_FLUSH}, {_digests('flush', 'priority')}, {DIMENSION}
  SELECT chunk, title, message, CASE number WHEN 5 THEN 10 WHEN 4 THEN 8 WHEN 3 THEN 5 ELSE number END AS server_priority,
    '{{"client::display":{{"contentType":"text/markdown"}},"client::notification":{{}}}}' AS extras
  FROM digest JOIN dim USING (priority)"""
ORACLES["feed_incoming_indexed"] = ORACLES["feed_incoming"]
ORACLES["versioned_queue"] = f"""WITH {PENDING}, marked AS (SELECT * REPLACE (CASE WHEN priority = 'Low' THEN {_SINCE - 1} ELSE sent_at END AS sent_at)
    FROM pending),
  again AS (SELECT id, CASE WHEN received_at >= {_SINCE} OR sent_at >= {_SINCE} THEN NULL ELSE sent_at END AS sent_at FROM marked)
  SELECT id, sent_at FROM again WHERE sent_at IS NULL OR sent_at >= {fx.NOW_MS - DAY}"""
ORACLES["kept_pending_counts"] = f"""WITH {PENDING}, marked AS (SELECT * REPLACE (CASE WHEN priority = 'Low' THEN {_SINCE - 1} ELSE sent_at END AS sent_at)
    FROM pending),
  again AS (SELECT * REPLACE (CASE WHEN received_at >= {_SINCE} OR sent_at >= {_SINCE} THEN NULL ELSE sent_at END AS sent_at) FROM marked),
  kept AS (FROM again WHERE sent_at IS NULL OR sent_at >= {fx.NOW_MS - DAY}),
  steps AS (SELECT 'marked' AS step, priority, sent_at FROM marked UNION ALL SELECT 'replayed', priority, sent_at FROM again
    UNION ALL SELECT 'retained', priority, sent_at FROM kept)
  SELECT s.step, p.priority, count(steps.step) AS n FROM (VALUES ('marked'), ('replayed'), ('retained')) s(step)
  CROSS JOIN (VALUES ('High'), ('Medium'), ('Low'), ('Not Necessary')) p(priority)
  LEFT JOIN steps ON steps.step = s.step AND steps.priority = p.priority AND steps.sent_at IS NULL GROUP BY ALL"""
ORACLES["kept_processed_counts"] = f"""WITH {FEED}, {_SEEN}, kept AS (FROM seen WHERE processed_at >= {fx.NOW_MS - 20 * DAY})
  SELECT asked_at, count(*) FILTER (WHERE processed_at > asked_at - {DAY}) AS processed_today,
    count(*) FILTER (WHERE processed_at > epoch_ms(date_trunc('month', make_timestamp(asked_at * 1000)))) AS processed_month
  FROM kept, (VALUES ({fx.NOW_MS}::BIGINT), ({fx.NOW_MS - 3 * DAY}), ({fx.NOW_MS - 3 * DAY + 1_234_567})) a(asked_at) GROUP BY asked_at"""
ORACLES["kept_daily_classifications"] = ORACLES["daily_classifications"]
ORACLES["stream_kept_counts"] = f"""WITH {PENDING} SELECT p.priority, count(pending.id) AS n
  FROM (VALUES ('High'), ('Medium'), ('Low'), ('Not Necessary')) p(priority)
  LEFT JOIN pending ON pending.priority = p.priority AND sent_at IS NULL AND pending.priority <> 'Low' GROUP BY p.priority"""
ORACLES["stream_ordered_calls"] = ORACLES["limited_calls"]
ORACLES["stream_flush_assignment"] = f"SELECT id, priority, flush_at FROM ({ORACLES['flush_assignment']})"
