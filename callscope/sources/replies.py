"""Raw replies to call rows: two JSON layouts, one table, failures kept as rows.

Raw replies have ``call_id, api, status, body, latency_ms``; any other columns
are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope import schemas
from callscope.functions import constants as K
from callscope.functions.text import extract_label

RESPONSES, CHAT = "responses", "chat"


def _parsed(body: Column) -> Column:
    return F.from_json(
        body,
        schemas.REPLY,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )


def responses_text(reply: Column) -> Column:
    """All output-text parts of the message items, joined without a separator."""
    empty_parts = F.array().cast("array<string>")

    def texts(item: Column) -> Column:
        parts = F.filter(item["content"], lambda part: part["type"] == K.TEXT_PART)
        return F.coalesce(
            F.transform(parts, lambda part: F.coalesce(part["text"], F.lit(""))), empty_parts
        )

    items = F.filter(reply["output"], lambda item: item["type"] == K.MESSAGE_ITEM)
    return F.coalesce(F.array_join(F.flatten(F.transform(items, texts)), ""), F.lit(""))


def chat_text(reply: Column) -> Column:
    """Content of the first choice; empty without one."""
    return F.coalesce(F.try_element_at(reply["choices"], F.lit(1))["message"]["content"], F.lit(""))


def _usage(reply: Column) -> list[Column]:
    usage = reply["usage"]
    layouts = {
        "input_tokens": (usage["input_tokens"], usage["prompt_tokens"]),
        "cached_tokens": (
            usage["input_tokens_details"]["cached_tokens"],
            usage["prompt_tokens_details"]["cached_tokens"],
        ),
        "output_tokens": (usage["output_tokens"], usage["completion_tokens"]),
    }
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(*fields, zero).alias(name) for name, fields in layouts.items()]


def _failure(status: Column, body: Column, reply: Column) -> Column:
    # The reply is looked at once: a filter on the error would parse per mention.
    blank = F.coalesce(~body.rlike(r"[^\x00-\x20]"), F.lit(True))
    broken = blank | reply["_corrupt_record"].isNotNull()
    return F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(
        broken, F.lit("malformed body")
    )


def _parse(raw: DataFrame, text: Column) -> DataFrame:
    reply = F.col("_reply")
    kept = [c for c in raw.columns if c != "body"]
    rows = raw.withColumn("_reply", _parsed(F.col("body"))).select(
        *kept,
        "body",
        _failure(F.col("status"), F.col("body"), reply).alias("error"),
        text.alias("response_text"),
        *_usage(reply),
    )
    # A failed call keeps its row, latency and the start of its body; no metrics.
    failed = F.col("error").isNotNull()
    return rows.select(
        *kept,
        "error",
        F.when(failed, F.substring("body", 1, K.ERROR_PREVIEW)).alias("error_body"),
        *[
            F.when(~failed, F.col(c)).alias(c)
            for c in ("response_text", "input_tokens", "cached_tokens", "output_tokens")
        ],
        F.when(~failed, extract_label(F.col("response_text"))).alias("label"),
    )


def parse_responses(raw: DataFrame) -> DataFrame:
    """Replies in the typed-item layout."""
    return _parse(raw, responses_text(F.col("_reply")))


def parse_chat(raw: DataFrame) -> DataFrame:
    """Replies in the chat layout."""
    return _parse(raw, chat_text(F.col("_reply")))


def parse_replies(raw: DataFrame) -> DataFrame:
    """Replies of both layouts, told apart by ``api``, in one pass."""
    reply = F.col("_reply")
    return _parse(
        raw, F.when(F.col("api") == CHAT, chat_text(reply)).otherwise(responses_text(reply))
    )


def normalize_usage(raw: DataFrame) -> DataFrame:
    """Token counts of both layouts; a missing level counts as 0."""
    parsed = raw.withColumn("_reply", _parsed(F.col("body")))
    return parsed.select("call_id", "api", *_usage(F.col("_reply")))


def capture_errors(raw: DataFrame) -> DataFrame:
    """Only the failed calls, with what they said.

    A body is parsed once, and only to see whether it is whole; a filter on the error
    itself would be pushed below its projection and parse once more.
    """
    reply = F.from_json(
        F.col("body"),
        "_corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    failure = _failure(F.col("status"), F.col("body"), reply)
    kept = [F.col(c) for c in raw.columns if c != "body"]
    failed = raw.select(*kept, "body", F.explode_outer(F.array(failure)).alias("error"))
    return failed.where(F.col("error").isNotNull()).select(
        *kept,
        "error",
        F.substring("body", 1, K.ERROR_PREVIEW).alias("error_body"),
        F.lit(None).cast("string").alias("response_text"),
        *[
            F.lit(None).cast("bigint").alias(c)
            for c in ("input_tokens", "cached_tokens", "output_tokens")
        ],
        F.lit(None).cast("string").alias("label"),
    )
