"""Prompt-cache analytics per cache key: hit rate, cost, hygiene, gaps, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import constants as K
from callscope.functions import metrics as M
from callscope.operators.ordered import (
    SLICE,
    previous,
    slice_hot_keys,
    sliced_previous,
    sliced_running_sum,
)
from callscope.operators.runs import ok_calls

ORDER = ("started_at", "call_id")


def hit_rate(calls: DataFrame, keys: tuple[str, ...] = ("cache_key",)) -> DataFrame:
    """Share of calls with cached tokens, and cached share of all input tokens."""
    grouped = ok_calls(calls).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("cached_tokens") > 0).alias("hits"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"),
    )
    return grouped.withColumns(
        {
            "call_hit_rate": M.mean(F.col("hits"), F.col("calls")),
            "token_hit_rate": M.mean(F.col("cached_tokens"), F.nullif("input_tokens", F.lit(0))),
        }
    )


def cost_summary(
    calls: DataFrame, keys: tuple[str, ...] = ("cache_key",), discount: str = K.CACHED_DISCOUNT
) -> DataFrame:
    """Token totals, tokens billed after the discount on cached input, and the saving."""
    totals = ok_calls(calls).groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"),
    )
    billed = M.billed_tokens(F.col("input_tokens"), F.col("cached_tokens"), discount)
    return totals.withColumn("billed_tokens", billed).withColumn(
        "saving_pct", M.saving_pct(F.col("input_tokens"), F.col("billed_tokens"))
    )


def key_hygiene(calls: DataFrame, prefix: str = "prompt_text") -> DataFrame:
    """Cache keys used with several prefixes, and prefixes used under several keys.

    The pairs are made distinct first, so a key with most of the calls is one row
    per prefix by the time the counts are shuffled.
    """
    pairs = (
        calls.select("cache_key", F.sha2(F.col(prefix).cast("string"), 256).alias("prefix_sha"))
        .where(F.col("cache_key").isNotNull() & F.col("prefix_sha").isNotNull())
        .distinct()
    )

    def side(kind: str, column: str) -> DataFrame:
        return (
            pairs.groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("others"))
            .where(F.col("others") > 1)
            .select(F.lit(kind).alias("finding"), "value", "others")
        )

    return side("key with several prefixes", "cache_key").unionByName(
        side("prefix under several keys", "prefix_sha")
    )


def condition_check(calls: DataFrame) -> DataFrame:
    """Cold and warm calls per API, and whether every cold bucket is unique."""
    bucket = F.coalesce("isolation_key", "cache_key")
    tagged = calls.select(
        "api",
        M.condition_of(F.col("isolation_key"), F.col("cache_key")).alias("cond"),
        bucket.alias("bucket"),
    )
    per_bucket = tagged.groupBy("api", "cond", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_bucket.groupBy("api", "cond")
        .agg(F.sum("n").alias("calls"), F.count("bucket").alias("buckets"))
        .withColumn("all_unique", F.col("calls") == F.col("buckets"))
    )


def retention_gaps(calls: DataFrame, retention: str, **cut: int) -> DataFrame:
    """Idle time before each call on its key; calls after more than the retention.

    ``expected_cold`` marks the first call of a key and those after a longer gap;
    ``observed_cold`` marks calls without cached tokens.
    """
    held = previous(calls, ["cache_key"], ORDER, "started_at", "_before", **cut)
    return _gap_columns(held, retention)


def _gap_columns(held: DataFrame, retention: str) -> DataFrame:
    at, before = F.col("started_at"), F.col("_before")
    return held.withColumns(
        {
            "gap_us": F.unix_micros(at) - F.unix_micros(before),
            "expected_cold": F.coalesce(at > before + F.expr(f"INTERVAL {retention}"), F.lit(True)),
            "observed_cold": F.coalesce(F.col("cached_tokens") == 0, F.lit(False)),
        }
    ).drop("_before")


def gap_summary(gaps: DataFrame) -> DataFrame:
    """How far expected and observed cold calls agree, per key."""
    expected, observed = F.col("expected_cold"), F.col("observed_cold")
    return gaps.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(expected).alias("expected_cold"),
        F.count_if(observed).alias("observed_cold"),
        F.count_if(expected & observed).alias("both"),
        F.max("gap_us").alias("longest_gap_us"),
    )


def warm_sessions(calls: DataFrame, retention: str, **cut: int) -> DataFrame:
    """Stretches of calls on one key with no gap longer than the retention.

    Sessions are numbered by a running sum over the gaps, so a key that holds most
    of the log is cut into slices and its sessions are summed up on the map side.
    """
    keys = ["cache_key"]
    sliced = slice_hot_keys(calls, keys, ORDER, **cut)
    gaps = sliced_previous(sliced, keys, ORDER, "started_at", "_before").map(
        lambda part: _gap_columns(part, retention)
    )
    starts = F.col("expected_cold").cast("bigint")
    numbered = sliced_running_sum(gaps, keys, ORDER, starts, "session_no").rows.drop(SLICE)
    return numbered.groupBy("cache_key", "session_no").agg(
        F.min("started_at").alias("first_call_at"),
        F.max("started_at").alias("last_call_at"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("cached_tokens") > 0).alias("hits"),
        F.coalesce(
            F.bool_or(F.col("expected_cold") & F.col("observed_cold")), F.lit(False)
        ).alias("first_was_cold"),
    )


def cache_health(calls: DataFrame, width: str) -> DataFrame:
    """Hit rate and mean latency per key and tumbling window; batch or streaming."""
    ok = ~M.is_error(F.col("error"))
    grouped = calls.groupBy(F.window("started_at", width), "cache_key").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & (F.col("cached_tokens") > 0)).alias("hits"),
        F.sum(F.when(ok, F.col("latency_ms"))).alias("latency_sum_ms"),
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), "cache_key", "calls", "errors", "hits",
        "latency_sum_ms",
    )


def health_rates(health: DataFrame) -> DataFrame:
    """Rates of :func:`cache_health` rows."""
    good = F.nullif(F.col("calls") - F.col("errors"), F.lit(0))
    return health.select(
        "window_start",
        "cache_key",
        "calls",
        "errors",
        M.mean(F.col("hits"), good).alias("hit_rate"),
        M.mean(F.col("latency_sum_ms"), good).alias("mean_latency_ms"),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts share from their start, by halving steps."""
    shorter = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def further(shared: Column, step: Column) -> Column:
        there = step <= shorter - shared
        same = F.left(a, shared + step) == F.left(b, shared + step)
        return F.when(F.when(there, same).otherwise(False), shared + step).otherwise(shared)

    return F.aggregate(steps, F.lit(0), further)


def shared_prefix(requests: DataFrame, keys: tuple[str, ...] = ("cache_key",), body: str = "body") -> DataFrame:
    """The characters that all request bodies of a cache key begin with, which is what its cache can hold.

    All texts between the first and the last in order share what these two share, so an aggregate of both
    per key is enough, combined before the shuffle; no pair of requests is formed. Null bodies are none.
    """
    text = F.col(body)
    ends = requests.groupBy(*keys).agg(
        F.count(text).alias("requests"),
        F.min(text).alias("_first"),
        F.max(text).alias("_last"),
        F.min(F.length(text)).cast("bigint").alias("shortest_chars"),
    )
    shared = common_prefix(F.col("_first"), F.col("_last")).cast("bigint")
    return ends.select(*keys, "requests", shared.alias("shared_chars"), "shortest_chars")
