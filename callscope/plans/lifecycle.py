"""Whole-run reports: what one look at a call log usually asks for.

Each function only puts operators together; every field is a lazy DataFrame.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.text import extract_label
from callscope.operators import cache, runs, store, ttft
from callscope.sources.reports import report_table


class CachingReport(NamedTuple):
    """Is the prompt cache used, and what does it bring?"""

    table: DataFrame
    tags: DataFrame
    summary: DataFrame
    hit_rate: DataFrame
    cost: DataFrame


class ApiComparison(NamedTuple):
    """Two API shapes side by side, each with its time-to-first-token test."""

    latency: DataFrame
    summary: DataFrame
    proof: DataFrame


class StoreAudit(NamedTuple):
    """From creation to deletion: what is found, what context it has, what is left."""

    retrieved: DataFrame
    context: DataFrame
    leaked: DataFrame
    dangling: DataFrame


def caching_report(calls: DataFrame, mode: str = "baseline") -> CachingReport:
    """Report of runs with (``baseline``) or without (``first_vs_rest``) a warm-up call."""
    calls = calls.withColumn("label", extract_label(F.col("response_text")))
    if mode == "baseline":
        measured = runs.calls_after_warmup(calls)
        tags = runs.tagged(runs.ok_calls(measured), "tokens_then_latency")
    else:
        measured = calls
        tags = runs.tagged(runs.ok_calls(calls), "tokens")
    return CachingReport(
        table=report_table(runs.call_ordinal(measured)),
        tags=tags,
        summary=runs.run_summary(calls, mode),
        hit_rate=cache.hit_rate(measured),
        cost=cache.cost_summary(measured),
    )


def api_comparison(
    responses: DataFrame, chat: DataFrame, proof: DataFrame
) -> ApiComparison:
    """Calls of both APIs held together, and the verdict per API."""
    both = responses.withColumn("api", F.lit("responses")).unionByName(
        chat.withColumn("api", F.lit("chat")), allowMissingColumns=True
    )
    return ApiComparison(
        latency=runs.compare_apis(both),
        summary=runs.run_summary(both, "baseline"),
        proof=ttft.ttft_ab(proof),
    )


def store_audit(created: DataFrame, deleted: DataFrame, follow_ups: DataFrame) -> StoreAudit:
    """Look-up of all created ids, context of the follow-ups, leaks and lost parents."""
    live = store.delete(created, deleted)
    return StoreAudit(
        retrieved=store.retrieve(created.select("response_id"), live),
        context=store.rebuild_context(follow_ups, created),
        leaked=store.leak_audit(created, deleted),
        dangling=store.dangling_parents(live),
    )
