"""Streams read in several batches give what the batch operators give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callscope.operators import cache, policy, ttft
from callscope.plans import views as V
from callscope.streaming import live


def _write_in_order(df, at, files, path):
    """One file after the other, oldest rows first, so that none is late for the watermark."""
    ends = df.agg(F.percentile_approx(at, [i / files for i in range(1, files)])).first()[0]
    for low, high in zip([None, *ends], [*ends, None]):
        part = df
        if low is not None:
            part = part.where(F.col(at) >= F.lit(low))
        if high is not None:
            part = part.where(F.col(at) < F.lit(high))
        part.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    """The calls as six files in time order, so that the watermark moves between batches."""
    path = str(tmp_path_factory.mktemp("log") / "calls")
    calls = V.load_calls(spark, sf_dir)
    _write_in_order(calls, "started_at", 6, path)
    return path


def _equal(got, want):
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert not want.isEmpty()


def test_health(spark, log):
    stream = live.read_log(spark, log, files_per_batch=1)
    closed = live.run_once(live.health_stream(stream, "6 HOURS", "1 HOUR"), "health")
    calls = spark.read.parquet(log)
    whole = cache.health_rates(cache.cache_health(calls, "6 HOURS"))
    assert 0 < closed.count() < whole.count()
    _equal(live.health_view(closed, calls, "6 HOURS"), whole)


def test_health_before_anything_is_closed(spark, log):
    calls = spark.read.parquet(log)
    nothing = cache.cache_health(calls, "1 DAY").limit(0)
    whole = cache.health_rates(cache.cache_health(calls, "1 DAY"))
    _equal(live.health_view(nothing, calls, "1 DAY"), whole)


def test_closed_sessions_equal_batch_sessions(spark, log):
    stream = live.read_log(spark, log, files_per_batch=1)
    closed = live.run_once(live.session_stream(stream, "1 HOUR", "1 HOUR"), "sessions")
    batch = cache.warm_sessions(spark.read.parquet(log), "1 HOUR")
    columns = ["cache_key", "first_call_at", "last_call_at", "calls", "hits"]
    missing = batch.select(*columns).exceptAll(closed.select(*columns))
    assert closed.select(*columns).exceptAll(batch.select(*columns)).isEmpty()
    assert closed.count() > 100 and missing.count() <= 2 * 7  # the last ones are still open
    view = live.session_view(closed, spark.read.parquet(log), "1 HOUR")
    _equal(view, batch.select(*columns))


@pytest.mark.parametrize("typed", [False, True])
def test_chunks(spark, sf_dir, tmp_path, typed):
    path = str(tmp_path / "chunks")
    _write_in_order(V.load_chunks(spark, sf_dir), "ts", 4, path)
    stream = live.read_log(spark, path, files_per_batch=1)
    closed = live.run_once(live.chunk_stream(stream, "1 DAY", "1 HOUR", span=16), "groups")
    chunks, requests = spark.read.parquet(path), V.load_requests(spark, sf_dir)
    assert closed.count() > 0
    _equal(
        live.ttft_view(closed, chunks, requests, "1 DAY", typed, span=16, levels=2),
        ttft.ttft_from_chunks(chunks, requests, typed),
    )


def test_labels_and_verdicts(spark, sf_dir, log):
    stream = live.read_log(spark, log, files_per_batch=2)
    labels = live.run_once(live.label_stream(stream).select("call_id", "label"), "labels")
    _equal(labels, V.labelled(spark.read.parquet(log)).select("call_id", "label"))
    messages = V.load_messages(spark, sf_dir)
    judged = live.classify_stream(V.messages(live.read_log(spark, V.log_path(sf_dir, "conversations"))), V.RULES)
    verdicts = live.run_once(judged.select("msg_id", "verdict"), "verdicts")
    _equal(verdicts, policy.apply_policy(messages, V.RULES).select("msg_id", "verdict"))


def test_a_restarted_stream_goes_on_where_it_stopped(spark, sf_dir, tmp_path):
    """The sink holds each call once, although the job ran twice over a growing log."""
    source, sink, state = (str(tmp_path / name) for name in ("source", "sink", "state"))
    calls = V.load_calls(spark, sf_dir).select("call_id", "response_text")
    for part in (0, 1):
        calls.where(F.col("call_id") % 2 == part).write.mode("append").parquet(source)
        stream = live.label_stream(live.read_log(spark, source))
        live.append_to(stream, sink, state).awaitTermination()
    written = spark.read.parquet(sink)
    assert written.count() == calls.count() == written.select("call_id").distinct().count()


def _one_file_each(rows, path):
    for row in rows:
        row.coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_in_the_views(spark, tmp_path):
    """Five calls in five files, one older than the watermark: none is lost."""
    path = str(tmp_path / "late")
    hours = [1, 30, 60, 2, 90]
    calls = [
        spark.createDataFrame([(i, h * 3600, 5, "k")], "call_id bigint, at bigint, cached_tokens bigint, cache_key string")
        .select(
            "call_id", "cache_key", "cached_tokens", F.timestamp_seconds("at").alias("started_at"),
            F.lit(None).cast("string").alias("error"), F.lit(1).cast("decimal(18,2)").alias("latency_ms"),
        )
        for i, h in enumerate(hours)
    ]
    _one_file_each(calls, path)
    log = spark.read.parquet(path)
    closed = live.run_once(live.health_stream(live.read_log(spark, path, 1), "1 DAY", "1 HOUR"), "health")
    assert closed.agg(F.sum("calls")).first()[0] < 4  # the late one is not in its window
    _equal(live.health_view(closed, log, "1 DAY"), cache.health_rates(cache.cache_health(log, "1 DAY")))
    written = live.run_once(live.session_stream(live.read_log(spark, path, 1), "3 HOURS", "1 HOUR"), "sessions")
    want = cache.warm_sessions(log, "3 HOURS").select(*written.columns)
    assert want.agg(F.sum("calls")).first()[0] == 5
    _equal(live.session_view(written, log, "3 HOURS"), want)


def test_late_chunks_are_in_the_view(spark, tmp_path):
    path = str(tmp_path / "late")
    times = [1, 40, 80, 2, 120]
    rows = [
        spark.createDataFrame([(1, i + 1, h * 3600, f"t{i} ")], "request_id bigint, seq bigint, at bigint, delta string")
        .select("request_id", "seq", F.timestamp_seconds("at").alias("ts"), F.lit("x").alias("event_type"), "delta")
        for i, h in enumerate(times)
    ]
    _one_file_each(rows, path)
    log = spark.read.parquet(path)
    requests = spark.createDataFrame([(1, 0)], "request_id bigint, at bigint").select(
        "request_id", F.timestamp_seconds("at").alias("sent_at")
    )
    closed = live.run_once(live.chunk_stream(live.read_log(spark, path, 1), "1 DAY", "1 HOUR"), "groups")
    got = live.ttft_view(closed, log, requests, "1 DAY")
    assert got.first().chunks == 5
    _equal(got, ttft.ttft_from_chunks(log, requests))
