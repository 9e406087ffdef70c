"""Run analytics on recorded runs: latency, input and cached tokens per call."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callscope.functions import metrics as M
from callscope.operators import cache, runs

# Five recorded runs (warm-up latency, then five calls).
RUNS = {
    "G": (None, [(2846, 1289, 0), (3549, 1287, 1268), (1869, 1291, 1268), (1620, 1287, 1268), (2245, 1291, 1268)]),
    "C1": (2461, [(2004, 1346, 1345), (1401, 1344, 1343), (1457, 1348, 0), (1768, 1344, 1343), (1144, 1348, 1347)]),
    "K2": (3386, [(2769, 1342, 1280), (1950, 1340, 1280), (2601, 1344, 1280), (1689, 1340, 1280), (1646, 1344, 1280)]),
    "C2": (1866, [(1632, 1346, 1345), (2073, 1344, 1343), (1552, 1348, 0), (1275, 1344, 1343), (1090, 1348, 1347)]),
    "S3": (3557, [(2475, 1342, 1280), (1596, 1340, 1280), (4562, 1344, 0), (3414, 1340, 1280), (2483, 1344, 0)]),
}
PCT = {
    "G": [0, 99, 98, 99, 98],
    "C1": [100, 100, 0, 100, 100],
    "K2": [95, 96, 95, 96, 95],
    "C2": [100, 100, 0, 100, 100],
    "S3": [95, 96, 0, 96, 0],
}
ACTIVE = "WARM (prompt_cache_key active)"
TAGS = {
    "G": ("tokens", ["COLD"] + [f"WARM ({p}% cached)" for p in (99, 98, 99, 98)]),
    "C1": ("latency", [f"WARM ({r}× faster than cold)" for r in ("1.2", "1.8", "1.7", "1.4", "2.2")]),
    "K2": ("tokens_then_latency", [f"WARM ({p}% cached)" for p in (95, 96, 95, 96, 95)]),
    "C2": (
        "tokens_then_latency",
        ["WARM (100% cached)"] * 2 + ["WARM (1.2× faster than cold)"] + ["WARM (100% cached)"] * 2,
    ),
    "S3": (
        "stored",
        ["WARM (1280 cached tkns)"] * 2
        + ["WARM (key active)", "WARM (1280 cached tkns)", "WARM (key active)"],
    ),
}
BASELINE = {
    "C1": (2461.0, 1554.8),
    "K2": (3386.0, 2131.0),
    "C2": (1866.0, 1524.4),
    "S3": (3557.0, 2906.0),
}
SAVING = {"G": 39.3, "C1": 40.0, "K2": 47.7, "C2": 40.0, "S3": 28.6}
API = {"G": "responses", "C1": "chat", "K2": "responses", "C2": "chat", "S3": "responses"}


def frame(spark, rows):
    df = spark.createDataFrame(
        rows,
        "call_id bigint, run_id string, api string, cache_key string, at double, latency double, "
        "input_tokens bigint, cached_tokens bigint, error string",
    )
    return df.select(
        "call_id", "run_id", "api", "cache_key",
        F.timestamp_seconds("at").alias("started_at"),
        F.col("latency").cast("decimal(18,2)").alias("latency_ms"),
        "input_tokens", "cached_tokens", "error",
    )


@pytest.fixture(scope="module")
def calls(spark):
    """The recorded calls; a run's warm-up is its call 0."""
    rows = []
    for run, (warmup, recorded) in RUNS.items():
        sequence = ([(warmup, 1334, 0)] if warmup else []) + recorded
        first = 0 if warmup else 1
        for no, (ms, given, cached) in enumerate(sequence, first):
            rows.append((no, run, API[run], run, 1000.0 + 10 * no, float(ms), given, cached, None))
    return frame(spark, rows)


def _measured(calls):
    return calls.where("call_id > 0")


def test_cache_pct(calls):
    got = _measured(calls).withColumn(
        "p", M.cache_hit_pct(F.col("cached_tokens"), F.col("input_tokens"))
    )
    rows = {(r.run_id, r.call_id): r.p for r in got.collect()}
    assert rows == {(run, i + 1): p for run, ps in PCT.items() for i, p in enumerate(ps)}


def test_ordinal_counts_from_the_warmup(calls):
    rows = runs.call_ordinal(calls).collect()
    assert all(r.call_no == r.call_id + (r.run_id != "G") for r in rows)


def test_tags(calls):
    warmups = calls.where("call_id = 0").select(
        "run_id", F.col("latency_ms").alias("cold_latency_ms")
    )
    joined = _measured(calls).join(warmups, "run_id", "left")
    for run, (policy, want) in TAGS.items():
        rows = runs.tagged(joined.where(F.col("run_id") == run), policy).orderBy("call_id").collect()
        assert [r.warm_tag for r in rows] == want, run


def test_summary_first_vs_rest(calls):
    row = runs.run_summary(calls.where("run_id = 'G'"), "first_vs_rest").first()
    assert (row.cold_latency_ms, row.warm_latency_ms, row.warm_calls) == (2846.0, 2320.75, 4)
    assert round(row.speedup, 3) == 1.226


def test_summary_baseline_both_ways(calls):
    kept = calls.where("run_id <> 'G'")
    warmups = runs.warmups(kept)
    one = {r.run_id: r for r in runs.run_summary(kept, "baseline").collect()}
    two = {
        r.run_id: r
        for r in runs.summary_against(_measured(kept), warmups).collect()
    }
    assert one == two
    for run, (cold, warm) in BASELINE.items():
        assert one[run].cold_latency_ms == cold
        assert abs(one[run].warm_latency_ms - warm) < 1e-9
        assert one[run].speedup == cold / one[run].warm_latency_ms


def test_cost(calls):
    cost = {r.cache_key: r for r in cache.cost_summary(_measured(calls)).collect()}
    assert {run: round(r.saving_pct, 1) for run, r in cost.items()} == SAVING
    assert cost["G"].cached_tokens == 5072 and cost["G"].input_tokens == 6445


def test_hit_rate(calls):
    rate = {r.cache_key: r for r in cache.hit_rate(_measured(calls)).collect()}
    assert {run: r.hits for run, r in rate.items()} == {"G": 4, "C1": 4, "K2": 5, "C2": 4, "S3": 3}
    assert round(rate["S3"].token_hit_rate, 3) == 0.572


def test_compare_apis(calls):
    row = runs.compare_apis(_measured(calls).where("run_id IN ('K2', 'C2')")).first()
    assert (row.responses_latency_ms, row.chat_latency_ms) == (2131.0, 1524.4)
    none = runs.compare_apis(_measured(calls).where("run_id = 'C2'")).first()
    assert none.responses_latency_ms == 0.0


def test_failures(spark):
    """A failed warm-up ends its run; failed calls count nowhere; one call is no summary."""
    ok, bad = None, "HTTP 500"
    rows = [
        (0, "failed warm-up", "chat", "k", 0.0, 50.0, None, None, bad),
        (1, "failed warm-up", "chat", "k", 1.0, 10.0, 10, 0, ok),
        (0, "single", "chat", "k", 0.0, 50.0, 10, 0, ok),
        (0, "later failure", "chat", "k", 0.0, 50.0, 10, 0, ok),
        (1, "later failure", "chat", "k", 1.0, 99.0, None, None, bad),
        (2, "later failure", "chat", "k", 2.0, 20.0, 10, 5, ok),
    ]
    calls = frame(spark, rows)
    baseline = runs.run_summary(calls, "baseline").collect()
    assert [(r.run_id, r.warm_calls, r.speedup) for r in baseline] == [("later failure", 1, 2.5)]
    first = {r.run_id: r.warm_latency_ms for r in runs.run_summary(calls, "first_vs_rest").collect()}
    assert first == {"later failure": 20.0}
    assert runs.calls_after_warmup(calls).select("run_id").distinct().count() == 1
    assert {r.speedup for r in runs.call_speedup(calls).collect()} == {1.0, 2.5}


def test_with_warmup_keeps_all_columns(calls):
    both = runs.with_warmup(
        _measured(calls).withColumn("extra", F.lit(1)), calls.where("call_id = 0")
    )
    assert both.count() == calls.count() and "extra" in both.columns
    assert both.where("extra IS NULL").count() == 4


def test_slowest(calls):
    slow = runs.slowest_calls(calls, 1).collect()
    assert {r.run_id: int(r.latency_ms) for r in slow} == {
        "G": 3549, "C1": 2461, "K2": 3386, "C2": 2073, "S3": 4562,
    }
    assert [int(r.latency_ms) for r in runs.slowest_overall(calls, 2).collect()] == [4562, 3557]


def test_unknown_names_are_refused(calls):
    with pytest.raises(ValueError):
        runs.run_summary(calls, "other")
    with pytest.raises(ValueError):
        M.warm_tag("other")


def test_key_hygiene(spark):
    rows = [("a", "p1"), ("a", "p1"), ("a", "p2"), ("b", "p2"), ("c", "p3"), (None, "p3"), ("c", None)]
    found = cache.key_hygiene(spark.createDataFrame(rows, "cache_key string, prompt_text string"))
    got = sorted((r.finding, r.others) for r in found.collect())
    assert got == [("key with several prefixes", 2), ("prefix under several keys", 2)]


def test_sessions_and_gaps(spark):
    times = [0.0, 10.0, 70.0, 131.0, 131.0, 500.0]
    rows = [(i, "r", "chat", "k", t, 1.0, 10, 0 if i in (0, 3) else 5, None) for i, t in enumerate(times)]
    calls = frame(spark, rows)
    gaps = cache.retention_gaps(calls, "60 SECONDS").orderBy("call_id").collect()
    assert [g.expected_cold for g in gaps] == [True, False, False, True, False, True]
    assert [g.observed_cold for g in gaps] == [True, False, False, True, False, False]
    assert [g.gap_us for g in gaps][:3] == [None, 10_000_000, 60_000_000]
    sessions = cache.warm_sessions(calls, "60 SECONDS").orderBy("session_no").collect()
    assert [(s.calls, s.hits, s.first_was_cold) for s in sessions] == [(3, 2, True), (2, 1, True), (1, 1, False)]
    summary = cache.gap_summary(cache.retention_gaps(calls, "60 SECONDS")).first()
    assert (summary.calls, summary.expected_cold, summary.observed_cold, summary.both) == (6, 3, 2, 2)
