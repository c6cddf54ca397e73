"""Push notifications: JSON envelope around a base64 JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import strict_object
from ..functions.once import compute_once
from ..functions.text import bytes_as_latin1, decode_base64url, is_account

PAYLOAD = "emailAddress:string,historyId:string"
ENVELOPE = "message:struct<data:string,messageId:string>"


def decode_envelopes(pushes: DataFrame, body: str = "body") -> DataFrame:
    """Add ``push_id, account, history_id, reject_reason`` to raw push bodies.

    ``reject_reason`` is NULL for a usable notification. Nothing raises: a row that
    cannot be used is kept with its reason, so every input row comes out once.
    """
    read = compute_once(pushes, _envelope=strict_object(F.col(body), ENVELOPE))
    data = bytes_as_latin1(decode_base64url(F.col("_envelope.message.data")))
    decoded = compute_once(read, _payload=strict_object(data, PAYLOAD))
    return decoded.select(
        *pushes.columns,
        F.col("_envelope.message.messageId").alias("push_id"),
        F.col("_payload.emailAddress").alias("account"),
        F.col("_payload.historyId").alias("history_id"),
        _reject_reason().alias("reject_reason"),
    )


def _reject_reason() -> Column:
    return (
        F.when(F.col("_envelope").isNull(), "bad_json")
        .when(F.col("_envelope.message").isNull(), "no_message")
        .when(F.col("_payload").isNull(), "bad_envelope")
        .when(F.col("_payload.historyId").isNull(), "no_history_id")
        .when(~is_account(F.col("_payload.emailAddress")), "bad_account")
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reject_reason").isNotNull())
