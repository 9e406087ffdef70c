"""Executed plans: what is pushed down, what is shuffled, what stays out."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from callscope.operators import cache, runs, store, ttft
from callscope.operators.lookup import lookup
from callscope.plans import views as V
from callscope.plans.catalog import QUERIES


def executed(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON = {"classify_batch"}


STREAMS = {name for name in QUERIES if name.endswith("_stream")}
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "ArrowEval")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - STREAMS))
def test_no_python_and_no_pairs_of_everything(spark, sf_dir, name):
    plan = planned(QUERIES[name](spark, sf_dir))
    assert [word for word in UNWANTED if word in plan] == []


@pytest.mark.parametrize(
    "name,columns",
    [
        ("hit_rate", {"event_type", "user_id", "props"}),
        ("call_ordinal", {"event_id", "ts", "user_id"}),
        ("preview", {"conv_id", "turn", "text"}),
        ("created_ts", {"conv_id", "turn"}),
        ("cache_hit_pct", {"event_id", "props"}),
    ],
)
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    plan = planned(QUERIES[name](spark, sf_dir))
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan):
        assert {field.split(":")[0] for field in schema.split(",") if field} <= columns


def test_filters_reach_the_scan(spark, sf_dir):
    plan = planned(V.load_messages(spark, sf_dir))
    assert "EqualTo(role,user)" in plan


@pytest.mark.parametrize(
    "make",
    [
        lambda c: runs.run_summary(c, "baseline"),
        lambda c: runs.run_summary(c, "first_vs_rest"),
        lambda c: runs.warmups(c),
        lambda c: cache.hit_rate(c),
        lambda c: ttft.ttft_ab(V.ttft(c)),
        lambda c: cache.cache_health(c, "1 DAY"),
    ],
)
def test_summaries_shuffle_once_and_only_partial_aggregates(spark, sf_dir, make):
    plan = executed(make(V.load_calls(spark, sf_dir)))
    assert "Window" not in plan and "Join" not in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    # The A/B test is summed up per session, then per report key.
    assert plan.count("Exchange") == (2 if "_write" in plan else 1)
    below = plan[plan.index("Exchange") :]
    assert "partial_" in below


def test_call_speedup_hashes_its_first_calls(spark, sf_dir):
    assert "SortAggregate" not in executed(runs.call_speedup(V.load_calls(spark, sf_dir)))


def test_ordinary_keys_cost_one_window_and_no_join(spark, sf_dir):
    plan = executed(runs.call_ordinal(V.load_calls(spark, sf_dir)))
    assert plan.count("Window ") == 1 and "Join" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    plan = executed(runs.slowest_calls(V.load_calls(spark, sf_dir), 3))
    shuffle, partial = plan.index("Exchange"), plan.index("3, Partial")
    assert partial > shuffle
    many = executed(runs.slowest_calls(V.load_calls(spark, sf_dir), 1_001))
    assert many.index("1001, Partial") > many.index("Exchange")
    assert "TakeOrdered" in planned(runs.slowest_overall(V.load_calls(spark, sf_dir), 3))


def test_hot_keys_are_broadcast_and_the_rest_shuffled(spark):
    """A third of the rows share one key: they are joined apart, by broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(6_000).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("key")
        )
        table = spark.range(6_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
        plan = executed(lookup(rows, table, "key", share=10, floor=100))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
        plan = executed(lookup(rows, table, "key"))
        assert plan.count("Join") == 1 and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("cut", [{}, {"share": 10, "floor": 0}])
def test_lookup_equals_a_plain_join(spark, how, cut):
    key = F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 != 0, F.col("id"))
    rows = spark.range(600).select("id", key.alias("key"))
    table = spark.range(0, 900, 2).select((F.col("id") + 1).alias("key"), F.col("id").alias("v"))
    want = rows.join(table, "key", how)
    got = lookup(rows, table, "key", how, **cut).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["apply_policy", "accuracy", "confusion"])
def test_policy_matches_its_patterns_once(spark, sf_dir, name):
    assert executed(QUERIES[name](spark, sf_dir)).count("RLIKE") == 3


def test_failed_bodies_are_parsed_once(spark, sf_dir):
    assert executed(QUERIES["error_rows"](spark, sf_dir)).count("from_json") == 1


def test_layout_lines_find_their_widths_in_one_pass(spark, sf_dir):
    plan = planned(QUERIES["layout_lines"](spark, sf_dir))
    assert len(set(re.findall(r"Subquery subquery#\d+", plan))) == 1


def test_chains_survive_without_local_checkpoints(spark, sf_dir):
    """Each round is read back from the shared folder, not from executor memory."""
    plan = planned(store.chain_links(V.load_stored(spark, sf_dir)))
    assert "Scan ExistingRDD" in plan
    assert spark.sparkContext.getCheckpointDir() is not None
