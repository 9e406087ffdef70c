"""Time to first token: recorded A/B runs, and chunk streams against brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callscope.functions import text as X
from callscope.operators import ttft

# Recorded first-token times in ms (cold runs, then the write, then reads).
RECORDED = {
    "chat-1": ([1803, 2001, 1827, 2297], [1672, 1902, 1347, 1486, 2341]),
    "responses": ([2882, 2530, 2163, 2288], [1384, 2520, 1761, 2036, 1617]),
    "chat-2": ([1701, 1752, 1528, 1746], [1411, 1806, 1414, 1519, 1409]),
}
WANT = {
    "chat-1": (1982.0, 1769.0, 1.1204, "CACHE LIKELY ACTIVE"),
    "responses": (2465.75, 1983.5, 1.2431, "CACHE LIKELY ACTIVE"),
    "chat-2": (1681.75, 1537.0, 1.0942, "CACHE NOT CONFIRMED"),
}


@pytest.fixture(scope="module")
def recorded(spark):
    rows = []
    for api, (cold, warm) in RECORDED.items():
        for cond, values in (("COLD", cold), ("WARM", warm)):
            rows += [(api, cond, float(i), i, float(ms)) for i, ms in enumerate(values)]
    df = spark.createDataFrame(rows, "api string, cond string, at double, call_id int, ms double")
    return df.select(
        "api",
        F.lit("one").alias("cache_key"),
        "cond",
        "call_id",
        F.timestamp_seconds("at").alias("started_at"),
        F.col("ms").cast("decimal(18,2)").alias("ttft_ms"),
    )


def test_recorded_ab(recorded):
    for row in ttft.ttft_ab(recorded).collect():
        cold, warm, ratio, verdict = WANT[row.api]
        assert (row.cold_ttft_ms, row.warm_ttft_ms, row.verdict) == (cold, warm, verdict)
        assert round(row.speedup, 4) == ratio
        assert (row.cold_runs, row.warm_reads) == (4, 4)


def test_ab_without_warm_reads(recorded):
    only_write = recorded.where("cond = 'COLD' OR call_id = 0")
    for row in ttft.ttft_ab(only_write).collect():
        assert (row.warm_reads, row.warm_ttft_ms, row.speedup) == (0, None, 0.0)
    cold_only = ttft.ttft_ab(recorded.where("cond = 'COLD'")).collect()
    assert all(row.warm_reads == 0 and row.speedup == 0.0 for row in cold_only)


def test_every_session_has_a_write_of_its_own(spark):
    """Two keys, writes 1000 ms, reads 500 ms, cold calls 1000 ms."""
    rows = [
        (key, cond, i, ms)
        for key in ("a", "b")
        for i, (cond, ms) in enumerate([("COLD", 1000), ("WARM", 1000), ("WARM", 500), ("WARM", 500)])
    ]
    df = spark.createDataFrame(rows, "cache_key string, cond string, call_id int, ms int").select(
        F.lit("x").alias("api"), "cache_key", "cond", "call_id",
        F.timestamp_seconds("call_id").alias("started_at"),
        F.col("ms").cast("decimal(18,2)").alias("ttft_ms"),
    )
    row = ttft.ttft_ab(df).first()
    assert (row.warm_ttft_ms, row.speedup, row.warm_reads, row.cold_runs) == (500.0, 2.0, 4, 2)
    tagged = ttft.ttft_tag(df, ("api", "cache_key")).where("cache_key = 'a'").orderBy("call_id").collect()
    assert [(r.tag, r.read_speedup) for r in tagged] == [
        ("run 1", None), ("write", None), ("read 1", 2.0), ("read 2", 2.0),
    ]
    nothing = ttft.ttft_tag(df.withColumn("ttft_ms", F.lit(0).cast("decimal(18,2)")), ("api", "cache_key"))
    assert {r.read_speedup for r in nothing.where("tag LIKE 'read%'").collect()} == {0.0}


def test_tags(recorded):
    tagged = ttft.ttft_tag(recorded).where("api = 'chat-1'").orderBy("cond", "call_id").collect()
    assert [r.tag for r in tagged] == [
        "run 1", "run 2", "run 3", "run 4", "write", "read 1", "read 2", "read 3", "read 4",
    ]


DELTA, DONE = "response.output_text.delta", "response.completed"
REQUESTS = {
    1: [("", DELTA), ("re", DELTA), ("view", DELTA), ("", DONE), (" block", DELTA)],
    2: [("", DELTA), ("", DELTA)],
    3: [(None, "response.created"), ("", DELTA), ("ALL", DELTA), ("OW", DELTA), (".", DELTA)],
    4: [(None, DONE)],
    5: [("x", DELTA)] * 40 + [(" ", DELTA), ("b", DELTA), ("lock", DELTA), ("\n", DELTA)] + [("y", DELTA)] * 9,
    6: [("\n", DELTA)] * 20 + [(" a", DELTA)] * 30,
    7: [("bl", DELTA), ("ock", DELTA), ("s", DELTA), (None, "response.in_progress")] * 5,
}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (request, seq, 100.0 * request + seq / 8, kind, delta)
        for request, deltas in REQUESTS.items()
        for seq, (delta, kind) in enumerate(deltas, 1)
    ]
    df = spark.createDataFrame(
        rows, "request_id bigint, seq bigint, at double, event_type string, delta string"
    )
    return df.withColumn("ts", F.timestamp_seconds("at")).drop("at").repartition(5)


@pytest.fixture(scope="module")
def requests(spark):
    """Requests sent half a second before their first chunk; the last one got none."""
    rows = [(r, 100.0 * r + 1 / 8 - 0.5) for r in [*REQUESTS, 99]]
    df = spark.createDataFrame(rows, "request_id bigint, at double")
    return df.withColumn("sent_at", F.timestamp_seconds("at")).drop("at")


def brute_force(spark, typed):
    """Timing in plain Python; the label from the whole text of each request."""
    rows = []
    for request, deltas in REQUESTS.items():
        read = list(enumerate(deltas, 1))
        if typed:
            done = [seq for seq, (_, kind) in read if kind == DONE]
            read = [(seq, d) for seq, d in read if not done or seq <= done[0]]
            text = [(seq, d or "") for seq, (d, kind) in read if kind == DELTA]
            tokens = [seq for seq, _ in text]
        else:
            text = [(seq, d or "") for seq, (d, _) in read]
            tokens = [seq for seq, d in text if d]
        first, last = read[0][0], read[-1][0]
        rows.append(
            (
                request,
                len(read),
                500_000 + (tokens[0] - first) * 125_000 if tokens else None,
                500_000 + (last - first) * 125_000,
                not tokens,
                "".join(d for _, d in text),
            )
        )
    rows.append((99, 0, None, None, True, ""))
    df = spark.createDataFrame(
        rows,
        "request_id bigint, chunks bigint, ttft_us bigint, total_us bigint, no_token boolean, text string",
    )
    return df.select(
        "request_id", "chunks", "ttft_us", "total_us", "no_token",
        F.length("text").cast("bigint").alias("text_chars"),
        X.extract_label(F.col("text")).alias("label"),
    )


@pytest.mark.parametrize("typed", [False, True])
@pytest.mark.parametrize("span,levels", [(1024, 3), (2, 6), (3, 2), (4, 1), (7, 3)])
def test_chunks_in_any_grouping(spark, chunks, requests, typed, span, levels):
    got = ttft.ttft_from_chunks(chunks, requests, typed, span, levels).collect()
    assert sorted(got) == sorted(brute_force(spark, typed).collect())


def test_first_token_is_timed_from_the_sending(chunks, requests):
    """Request 3's text begins with its third chunk, request 5's with its first."""
    timed = {r.request_id: r for r in ttft.ttft_from_chunks(chunks, requests).collect()}
    assert timed[5].ttft_us == 500_000
    assert timed[3].ttft_us == 500_000 + 2 * 125_000
    unsent = ttft.ttft_from_chunks(chunks, requests.where("request_id != 5")).collect()
    row = next(r for r in unsent if r.request_id == 5)
    assert row.ttft_us is None and not row.no_token and row.chunks == 53


def test_missing_first_token_falls_back_to_total(chunks, requests):
    timed = ttft.ttft_from_chunks(chunks, requests, typed=True)
    filled = ttft.fill_missing_first_token(timed)
    rows = {r.request_id: r for r in filled.collect()}
    assert rows[99].no_token and rows[99].ttft_us is None and rows[99].chunks == 0
    assert rows[4].no_token and rows[4].ttft_us == rows[4].total_us
    assert not rows[2].no_token
