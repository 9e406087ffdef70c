"""Structured Streaming jobs over call logs, token chunks and messages.

Every job appends to files in the shared folder. A window is written once the
watermark has passed it, and rows that come later than that are dropped by the stream. A
view counts the rows of the log per window, key or request; what was written with fewer
rows, or not yet, is computed from the log itself. So a view is whole at any time, late
rows included, and all that agrees is taken as written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.functions.text import extract_label
from callscope.operators import cache, policy, ttft
from callscope.operators.lookup import lookup
from callscope.session import new_path


def read_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder or file as a stream, with the schema of what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's final rows to parquet files until the log is read up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, name: str, provider: str | None = None) -> DataFrame:
    """Read the log up and return what was written; ``provider`` keeps the state of this stream."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, provider or before)
    try:
        append_to(stream, path, new_path(spark, f"{name}-state")).awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(path)


def health_stream(calls: DataFrame, width: str, delay: str) -> DataFrame:
    """Windowed cache health of a live call log; rows later than ``delay`` are dropped."""
    return cache.cache_health(calls.withWatermark("started_at", delay), width)


def health_view(closed: DataFrame, calls: DataFrame, width: str) -> DataFrame:
    """Written windows that hold all their calls; the others as the call log has them now."""
    start = F.window("started_at", width)["start"]
    counted = calls.groupBy(start.alias("_start"), F.col("cache_key").alias("_key")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    same = F.col("window_start").eqNullSafe(F.col("_start")) & F.col("cache_key").eqNullSafe(
        F.col("_key")
    )
    whole = closed.join(counted, same & (F.col("calls") == F.col("_n")), "left_semi")
    written = whole.select("window_start", F.col("cache_key").alias("_key"))
    rows = calls.withColumn("_start", start).join(written, same, "left_anti")
    tail = cache.cache_health(rows.drop("_start"), width)
    return cache.health_rates(whole.unionByName(tail))


def session_stream(calls: DataFrame, retention: str, delay: str) -> DataFrame:
    """Warm sessions of a live call log, each written once it can grow no more."""
    windowed = calls.withWatermark("started_at", delay).groupBy(
        F.session_window("started_at", retention), "cache_key"
    )
    return windowed.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("cached_tokens") > 0).alias("hits"),
        F.max("started_at").alias("last_call_at"),
    ).select(
        "cache_key",
        F.col("session_window.start").alias("first_call_at"),
        "last_call_at",
        "calls",
        "hits",
    )


def session_view(closed: DataFrame, calls: DataFrame, retention: str, **cut: int) -> DataFrame:
    """Written sessions, and those that may still grow as the call log has them now.

    The sessions of a key are written in order, so its open ones hold what comes
    after the last call of its last written session. A key whose log has more calls
    up to there than were written has late ones: it is read from the log anew.
    """
    key = F.struct("cache_key").alias("_key")  # equal also where both keys are NULL
    last = closed.groupBy(key).agg(
        F.max("last_call_at").alias("_last"), F.sum("calls").alias("_written")
    )
    rows = calls.select("cache_key", "started_at", "call_id", "cached_tokens", key)
    beside = lookup(rows, last, "_key", "left", **cut)
    upto = F.count_if(F.col("started_at") <= F.col("_last"))
    late = (
        beside.where(F.col("_last").isNotNull())
        .groupBy("_key")
        .agg(upto.alias("_have"), F.first("_written").alias("_written"))
        .where("_have != _written")
        .select("_key", F.lit(True).alias("_late"))
    )
    marked = lookup(beside, late, "_key", "left", **cut)
    after = F.coalesce(F.col("started_at") > F.col("_last"), F.lit(True))
    later = marked.where(F.coalesce("_late", F.lit(False)) | after)
    fresh = later.select("cache_key", "started_at", "call_id", "cached_tokens")
    tail = cache.warm_sessions(fresh, retention, **cut)
    whole = closed.withColumn("_key", key).join(late, "_key", "left_anti").drop("_key")
    return whole.unionByName(tail.select(*closed.columns))


def chunk_stream(
    chunks: DataFrame, width: str, delay: str, span: int = ttft.SPAN
) -> DataFrame:
    """Live token chunks gathered per request and window, ``span`` at most per row."""
    window = F.window("ts", width)
    grouped = ttft.group_chunks(chunks.withWatermark("ts", delay), span, window)
    return grouped.select(
        F.col("window.start").alias("window_start"), "request_id", "piece", "rows"
    )


def ttft_view(
    closed: DataFrame,
    chunks: DataFrame,
    requests: DataFrame,
    width: str,
    typed: bool = False,
    span: int = ttft.SPAN,
    levels: int = ttft.LEVELS,
) -> DataFrame:
    """Time to first token from written chunk groups and the chunks still open.

    A window's chunks of a request count as written if there are as many as in the
    log; the others are gathered from the log. ``width`` is that of the stream.
    """
    start = F.window("ts", width)["start"]
    same = F.col("window_start").eqNullSafe(F.col("_start")) & F.col("request_id").eqNullSafe(
        F.col("_request")
    )
    counted = chunks.groupBy(start.alias("_start"), F.col("request_id").alias("_request")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    held = closed.groupBy("window_start", "request_id").agg(F.sum(F.size("rows")).alias("_held"))
    whole = held.join(counted, same & (F.col("_held") == F.col("_n")), "left_semi")
    written = whole.select("window_start", F.col("request_id").alias("_request"))
    missing = chunks.withColumn("_start", start).join(written, same, "left_anti").drop("_start")
    kept = closed.join(whole.drop("_held"), ["window_start", "request_id"], "left_semi")
    tail = ttft.group_chunks(missing, span)
    pieces = kept.select("request_id", "piece", "rows").unionByName(tail)
    # Windows may have cut a group of chunks; it stays within the span once rejoined.
    groups = pieces.groupBy("request_id", "piece").agg(
        F.flatten(F.collect_list("rows")).alias("rows")
    )
    return ttft.ttft_from_groups(groups, requests, typed, span, levels)


def classify_stream(messages: DataFrame, rules: Sequence[policy.Rule]) -> DataFrame:
    """Live messages with their policy verdict; keeps no state."""
    return policy.apply_policy(messages, rules)


def label_stream(replies: DataFrame, text: str = "response_text") -> DataFrame:
    """Live replies with the label they state; keeps no state."""
    return replies.withColumn("label", extract_label(F.col(text)))
