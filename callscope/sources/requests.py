"""Request batches: messages in, one JSON body per message out, sharded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import constants as K
from callscope.functions.text import wrap_user_text
from callscope.operators.lookup import lookup


def read_messages(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "msg_id",
    text_col: str = "text",
    fmt: str = "parquet",
) -> DataFrame:
    """The messages to classify, as ``msg_id`` and ``text``."""
    read = spark.read.format(fmt)
    if fmt == "json":
        read = read.schema(f"`{id_col}` BIGINT, `{text_col}` STRING")
    return read.load(path).select(F.col(id_col).alias("msg_id"), F.col(text_col).alias("text"))


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def with_prompt(messages: DataFrame, prompts: DataFrame, **cut: int) -> DataFrame:
    """Attach the system prompt of each message's version, as late as possible.

    Messages carry only a version number until here; the long text is joined in
    where the body is built, and a message without a version keeps none. Most
    messages share one version, so the texts of such versions are broadcast.
    """
    texts = prompts.select("prompt_version", F.col("text").alias("prompt_text"))
    return lookup(messages, texts, "prompt_version", "left", **cut)


def _item(role: str, text: Column, mode: str | None = None) -> Column:
    breakpoint_ = F.lit(None).cast("struct<mode:string>")
    if mode is not None:
        breakpoint_ = F.struct(F.lit(mode).alias("mode"))
    part = F.struct(
        F.lit("input_text").alias("type"),
        text.alias("text"),
        breakpoint_.alias("prompt_cache_breakpoint"),
    )
    return F.struct(
        F.lit(K.MESSAGE_ITEM).alias("type"),
        F.lit(role).alias("role"),
        F.array(part).alias("content"),
    )


def build_responses_requests(
    messages: DataFrame,
    prompts: DataFrame,
    *,
    model: str,
    role: str = "system",
    breakpoint_mode: str | None = None,
    max_output_tokens: int | None = K.MAX_OUTPUT_TOKENS,
    stream: bool | None = None,
    store: bool | None = False,
) -> DataFrame:
    """One typed-item body per message; members without a value are left out.

    ``cache_key`` and ``previous_response_id`` columns are used where ``messages``
    has them. A message without a prompt version sends its own item alone, as a
    follow-up to a stored response does.
    """
    held = with_prompt(messages, prompts)
    system = F.when(
        F.col("prompt_text").isNotNull(), _item(role, F.col("prompt_text"), breakpoint_mode)
    )
    user = _item("user", wrap_user_text(F.col("text")))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array_compact(F.array(system, user)).alias("input"),
        F.lit(max_output_tokens).cast("int").alias("max_output_tokens"),
        F.lit(stream).cast("boolean").alias("stream"),
        F.lit(store).cast("boolean").alias("store"),
        _optional(held, "cache_key").alias("prompt_cache_key"),
        _optional(held, "previous_response_id").alias("previous_response_id"),
    )
    return held.select(
        "msg_id", _optional(held, "cache_key").alias("cache_key"), F.to_json(body).alias("body")
    )


def build_chat_requests(
    messages: DataFrame,
    prompts: DataFrame,
    *,
    model: str,
    max_tokens: int = K.MAX_OUTPUT_TOKENS,
    temperature: float = K.TEMPERATURE,
    stream: bool | None = None,
) -> DataFrame:
    """One chat body per message; cache members only where their column has a value."""
    held = with_prompt(messages, prompts)

    def turn(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    system = F.when(F.col("prompt_text").isNotNull(), turn("system", F.col("prompt_text")))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array_compact(F.array(system, turn("user", wrap_user_text(F.col("text"))))).alias(
            "messages"
        ),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit(temperature).cast("double").alias("temperature"),
        F.lit(stream).cast("boolean").alias("stream"),
        _optional(held, "cache_key").alias("prompt_cache_key"),
        _optional(held, "isolation_key").alias("prompt_cache_isolation_key"),
    )
    return held.select(
        "msg_id", _optional(held, "cache_key").alias("cache_key"), F.to_json(body).alias("body")
    )


def write_requests(
    requests: DataFrame, path: str, *, max_records_per_file: int = 1_000_000
) -> None:
    """Write JSON-lines shards, one folder per cache key.

    A worker that reads one folder keeps hitting one cached prefix. Rows are
    gathered per key by rebalancing, which splits a key that holds most of the
    requests over as many writing tasks as its size asks for.
    """
    (
        requests.hint("rebalance", "cache_key")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("cache_key")
        .json(path)
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Shards written by :func:`write_requests`, with their key."""
    return spark.read.schema("msg_id BIGINT, body STRING, cache_key STRING").json(path)
