"""Run analytics: warm-up baseline, per-call tags, summaries, API comparison.

A run is a sequence of calls, by ``started_at`` and ``call_id``; its first call
may be a warm-up that writes the prefix into the cache. Latencies are decimal, so
sums do not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import metrics as M
from callscope.operators.lookup import lookup
from callscope.operators.ordered import order_key, ordinal

ORDER = ("started_at", "call_id")


def ok_calls(calls: DataFrame) -> DataFrame:
    """Calls that succeeded."""
    return calls.where(~M.is_error(F.col("error")))


def call_ordinal(calls: DataFrame, name: str = "call_no", **cut: int) -> DataFrame:
    """Position of each call in its run, from 1."""
    return ordinal(calls, ["run_id"], ORDER, name, **cut)


def warmups(calls: DataFrame) -> DataFrame:
    """Runs whose first call succeeded, with its id and latency as the baseline.

    One aggregation: at most one row per run leaves each task.
    """
    at = order_key(calls, ORDER)
    ok_latency = F.when(~M.is_error(F.col("error")), F.col("latency_ms"))
    first = calls.groupBy("run_id").agg(
        F.min_by("call_id", at).alias("warmup_call_id"),
        F.min_by(ok_latency, at).alias("cold_latency_ms"),
    )
    return first.where(F.col("cold_latency_ms").isNotNull())


def attach_baseline(calls: DataFrame, warmup_rows: DataFrame, **cut: int) -> DataFrame:
    """Every call of a run with a good warm-up, with that warm-up's latency.

    A run whose warm-up failed yields no rows. Runs are as many as the log has, so
    they are not broadcast, apart from those that hold a large share of the calls.
    """
    return lookup(calls, warmup_rows.select("run_id", "cold_latency_ms"), "run_id", **cut)


def calls_after_warmup(calls: DataFrame, **cut: int) -> DataFrame:
    """Calls of warmed-up runs without the warm-up itself, baseline attached."""
    joined = lookup(calls, warmups(calls), "run_id", **cut)
    return joined.where(F.col("call_id") != F.col("warmup_call_id")).drop("warmup_call_id")


def with_warmup(results: DataFrame, warmup_calls: DataFrame) -> DataFrame:
    """Results with the warm-up rows appended, so that later steps see them too."""
    return results.unionByName(warmup_calls, allowMissingColumns=True)


def tagged(calls: DataFrame, policy: str, name: str = "warm_tag") -> DataFrame:
    """Add the warm tag of one policy; latency policies need ``cold_latency_ms``."""
    cold = F.col("cold_latency_ms") if "cold_latency_ms" in calls.columns else None
    tag = M.warm_tag(
        policy,
        cached=F.col("cached_tokens"),
        total=F.col("input_tokens"),
        latency=F.col("latency_ms"),
        cold=cold,
    )
    return calls.withColumn(name, tag)


def call_speedup(calls: DataFrame, **cut: int) -> DataFrame:
    """Each successful call against the first successful one of its run."""
    ok = ok_calls(calls)
    first = ok.groupBy("run_id").agg(
        F.min_by("latency_ms", order_key(ok, ORDER)).alias("first_latency_ms")
    )
    return lookup(ok, first, "run_id", **cut).withColumn(
        "speedup", M.speedup(F.col("first_latency_ms"), F.col("latency_ms"))
    )


def _sum(column: str, condition: Column) -> Column:
    return F.sum(F.when(condition, F.col(column)))


def run_summary(calls: DataFrame, mode: str) -> DataFrame:
    """Cold latency, mean warm latency and speedup per run, in one aggregation.

    ``first_vs_rest``  cold is the first successful call, warm the others; needs two.
    ``baseline``       cold is the run's first call as warm-up, which must have
                       succeeded; warm are all other successes; needs one.
    """
    ok = ~M.is_error(F.col("error"))
    at = order_key(calls, ORDER)
    if mode == "first_vs_rest":
        first = F.min_by("latency_ms", F.when(ok, at))
        usable = F.lit(True)
    elif mode == "baseline":
        first = F.min_by(F.when(ok, F.col("latency_ms")), at)
        usable = F.col("cold_latency_ms").isNotNull()
    else:
        raise ValueError(f"unknown summary mode: {mode}")
    grouped = calls.groupBy("run_id").agg(
        first.alias("cold_latency_ms"),
        _sum("latency_ms", ok).alias("_sum"),
        F.count_if(ok).alias("_n"),
    )
    warm_n = F.col("_n") - 1
    warm = M.mean(F.col("_sum") - F.col("cold_latency_ms"), warm_n)
    return grouped.where(usable & (warm_n >= 1)).select(
        "run_id",
        warm_n.alias("warm_calls"),
        F.col("cold_latency_ms").cast("double").alias("cold_latency_ms"),
        warm.alias("warm_latency_ms"),
        M.speedup(F.col("cold_latency_ms"), warm).alias("speedup"),
    )


def summary_against(calls: DataFrame, warmup_rows: DataFrame) -> DataFrame:
    """The ``baseline`` summary where warm-ups are a table of their own.

    Calls are reduced to one row per run before they meet the warm-ups.
    """
    per_run = ok_calls(calls).groupBy("run_id").agg(
        F.sum("latency_ms").alias("_sum"), F.count(F.lit(1)).alias("warm_calls")
    )
    warm = M.mean(F.col("_sum"), F.col("warm_calls"))
    return per_run.join(warmup_rows, "run_id").select(
        "run_id",
        "warm_calls",
        F.col("cold_latency_ms").cast("double").alias("cold_latency_ms"),
        warm.alias("warm_latency_ms"),
        M.speedup(F.col("cold_latency_ms"), warm).alias("speedup"),
    )


def compare_apis(
    calls: DataFrame, keys: tuple[str, ...] = (), apis: tuple[str, ...] = ("responses", "chat")
) -> DataFrame:
    """Mean latency per API shape side by side, failures left out, 0 where none is left."""
    columns = []
    for api in apis:
        mine = (F.col("api") == api) & ~M.is_error(F.col("error"))
        average = M.mean(_sum("latency_ms", mine), F.nullif(F.count_if(mine), F.lit(0)))
        columns.append(F.coalesce(average, F.lit(0.0)).alias(f"{api}_latency_ms"))
    return calls.groupBy(*keys).agg(*columns)


def slowest_calls(calls: DataFrame, k: int, keys: tuple[str, ...] = ("cache_key",)) -> DataFrame:
    """The k slowest successful calls per key, with their rank.

    The rank filter lets every task keep only its own k best before the shuffle, at
    any k: the session settings lift the planner's bound on it.
    """
    window = Window.partitionBy(*keys).orderBy(
        F.desc("latency_ms"), "cached_tokens", "call_id"
    )
    return (
        ok_calls(calls).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    )


def slowest_overall(calls: DataFrame, k: int) -> DataFrame:
    """The k slowest successful calls of the whole log."""
    return ok_calls(calls).orderBy(F.desc("latency_ms"), "cached_tokens", "call_id").limit(k)
