"""Tables that grow by one part per micro-batch equal the batch operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import cache
from callscope.session import new_path
from callscope.streaming import live, tables

COLUMNS = "call_id bigint, at bigint, cached_tokens bigint, cache_key string, error string, latency decimal(18,2)"


def _calls(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).select(
        "call_id", "cache_key", "cached_tokens", F.timestamp_seconds("at").alias("started_at"), "error",
        F.col("latency").alias("latency_ms"),
    )


def _equal(got, want):
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.count() == want.count() > 0


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Five files; every one has calls from all over the week, repeated instants and a null key."""
    chance = random.Random(6)
    path = str(tmp_path_factory.mktemp("late") / "calls")
    for file in range(5):
        rows = []
        for n in range(150):
            key = chance.choice(["hot"] * 8 + ["a", None])
            at = chance.randrange(0, 7 * 24) * 3600 + chance.choice([0, 0, 1800])
            rows.append((file * 1000 + n, at, chance.choice([0, 5]), key, chance.choice([None, None, "HTTP 500"]), None))
        _calls(spark, rows).withColumn("latency_ms", F.lit(2.5).cast("decimal(18,2)")).coalesce(1).write.mode("append").parquet(path)
    return path


def test_health(spark, late):
    parts = tables.health_table(spark, new_path(spark, "health"))
    log, stream = spark.read.parquet(late), live.read_log(spark, late, 1)
    summary = lambda rows: cache.cache_health(rows, "1 DAY")
    got = parts.follow_once(stream, summary)
    assert parts._folders() == (-1, [0, 1, 2, 3, 4])
    want = cache.cache_health(log, "1 DAY")
    _equal(got, want)
    assert got.agg(F.sum("calls")).first()[0] == 750
    assert not any(late in f for f in got.inputFiles())  # the log is not read
    # A batch that runs again changes nothing, neither before nor after parts were folded.
    parts.add(summary(log.where("call_id >= 1000 AND call_id < 2000")), 1)
    _equal(parts.read(), want)
    parts.fold()
    assert parts._folders() == (4, [])
    parts.add(summary(log.limit(50)), 3)
    _equal(parts.read(), want)
    parts.add(summary(log.where("call_id < 10")), 5)
    assert parts.read().agg(F.sum("calls")).first()[0] == 760
    parts.fold()
    assert parts._folders() == (5, []) and parts.read().agg(F.sum("calls")).first()[0] == 760


def test_an_unfinished_part_does_not_count(spark, late):
    parts = tables.health_table(spark, new_path(spark, "health"))
    assert parts.read() is None
    rows = cache.cache_health(spark.read.parquet(late), "1 DAY")
    parts.add(rows, 0)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{parts.path}/part=1")
    _equal(parts.read(), rows)


@pytest.mark.parametrize("retention, salts", [("1 HOUR", 64), ("3 HOURS", 3), ("30 MINUTES", 1)])
def test_sessions(spark, late, retention, salts):
    parts = tables.session_table(spark, new_path(spark, "sessions"), retention)
    stream = live.read_log(spark, late, 1)
    got = parts.follow_once(stream, lambda rows: tables.stretches(rows, retention, salts))
    want = cache.warm_sessions(spark.read.parquet(late), retention).select(*tables.SESSION)
    _equal(got, want)
    parts.fold()
    _equal(parts.read(), want)


def test_a_hot_key_is_spread(spark):
    """Nine calls in ten on one key: its stretches are made in all partitions."""
    rows = [(n, n * 60, 1, "hot" if n % 10 else "cold", None, None) for n in range(5000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = tables.stretches(_calls(spark, rows), "1 HOUR").where("cache_key = 'hot'")
        held = made.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("calls").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(held) == partitions and max(r.n for r in held) < 3 * 4500 / partitions


def test_an_empty_log(spark, tmp_path):
    path = str(tmp_path / "none")
    _calls(spark, []).write.parquet(path)
    parts = tables.session_table(spark, new_path(spark, "sessions"), "1 HOUR")
    assert parts.follow_once(live.read_log(spark, path), lambda rows: tables.stretches(rows, "1 HOUR")).isEmpty()
