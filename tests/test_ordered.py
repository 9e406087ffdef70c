"""Hot-key slicing gives what a plain window gives."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.operators import cache, ordered, runs, store
from callscope.plans import views as V

# Every key is hot under these settings, and cut into several slices.
CUTS = [
    {"share": 5, "floor": 0},
    {"share": 50, "floor": 10},
    {"share": 40, "floor": 0, "levels": 2},
    {"share": 20_000, "floor": 1_000_000},
]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key in two bursts, NULL keys and NULL times, ties."""
    n = 3_000
    rows = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 11 != 0, F.concat(F.lit("k"), (F.col("id") % 17).cast("string")))
        .alias("key"),
        F.when(
            F.col("id") % 101 != 0,
            F.when(F.col("id") % 2 == 0, F.col("id") / 50).otherwise(1_000_000 + F.col("id") % 40),
        )
        .cast("double")
        .alias("at"),
        (F.col("id") % 7).alias("v"),
    )
    return rows.repartition(6, "v")


ORDER = ["at", "id"]


def _equal(got, want):
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("cut", CUTS)
def test_ordinal(skewed, cut):
    plain = Window.partitionBy("key").orderBy(*ORDER)
    want = skewed.withColumn("n", F.row_number().over(plain).cast("bigint"))
    _equal(ordered.ordinal(skewed, ["key"], ORDER, "n", **cut), want)


@pytest.mark.parametrize("cut", CUTS)
def test_previous(skewed, cut):
    plain = Window.partitionBy("key").orderBy(*ORDER)
    want = skewed.withColumn("p", F.lag("at").over(plain))
    _equal(ordered.previous(skewed, ["key"], ORDER, "at", "p", **cut), want)


@pytest.mark.parametrize("cut", CUTS)
def test_running_sum(skewed, cut):
    plain = Window.partitionBy("key").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("s", F.sum("v").over(plain))
    _equal(ordered.running_sum(skewed, ["key"], ORDER, F.col("v"), "s", **cut), want)


def test_hot_keys_are_cut_and_others_are_not(skewed):
    sliced = ordered.slice_hot_keys(skewed, ["key"], ["at"], share=10, floor=0)
    per_key = {
        r.key: (r.slices, r.rows)
        for r in sliced.rows.groupBy("key")
        .agg(F.countDistinct(ordered.SLICE).alias("slices"), F.count("*").alias("rows"))
        .collect()
    }
    assert per_key["hot"][0] > 2
    assert per_key["k1"][0] == 0
    assert sliced.hot.select("key").distinct().count() == 1


def test_second_level_cuts_bursts(skewed):
    def widest(levels):
        sliced = ordered.slice_hot_keys(
            skewed, ["key"], ["at"], share=100, floor=0, levels=levels
        )
        sizes = sliced.hot.where("key = 'hot'").groupBy(ordered.SLICE).count()
        return sizes.agg(F.max("count")).first()[0]

    assert widest(2) < widest(1) / 3


def test_operators_on_cut_keys(spark, sf_dir):
    """The log operators give the same rows whether their keys are cut or not."""
    calls = V.load_calls(spark, sf_dir)
    stored = V.load_stored(spark, sf_dir)
    _equal(
        runs.call_ordinal(calls, share=500, floor=0).select("call_id", "call_no"),
        runs.call_ordinal(calls).select("call_id", "call_no"),
    )
    _equal(
        cache.retention_gaps(calls, "1 HOUR", share=20, floor=0).select("call_id", "gap_us", "expected_cold"),
        cache.retention_gaps(calls, "1 HOUR").select("call_id", "gap_us", "expected_cold"),
    )
    _equal(cache.warm_sessions(calls, "1 HOUR", share=20, floor=0), cache.warm_sessions(calls, "1 HOUR"))
    for operator in (runs.calls_after_warmup, runs.call_speedup):
        _equal(operator(calls, share=500, floor=0), operator(calls))
    _equal(
        store.chat_context(stored, share=2000, floor=0).select("response_id", "context_chars"),
        store.chat_context(stored).select("response_id", "context_chars"),
    )


@pytest.mark.parametrize("shape", ["ties", "burst beside a stray row", "stray row and ties"])
def test_default_levels_cut_ties_and_bursts(spark, shape):
    at = {
        "ties": F.lit(1_000),
        "burst beside a stray row": F.when(F.col("id") == 0, 0).otherwise(10**9 + F.col("id")),
        "stray row and ties": F.when(F.col("id") == 0, 0).otherwise(10**9),
    }[shape]
    rows = spark.range(10_000).select(
        F.lit("hot").alias("key"), F.timestamp_seconds(at).alias("at"), "id"
    )
    sliced = ordered.slice_hot_keys(rows, ["key"], ORDER, share=100, floor=0)
    sizes = [r["count"] for r in sliced.rows.groupBy(ordered.SLICE).count().collect()]
    assert max(sizes) <= 10_000 / 50 and sum(sizes) == 10_000
    plain = Window.partitionBy("key").orderBy(*ORDER)
    want = rows.withColumn("n", F.row_number().over(plain).cast("bigint"))
    _equal(ordered.ordinal(rows, ["key"], ORDER, "n", share=100, floor=0), want)
