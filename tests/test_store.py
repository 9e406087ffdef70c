from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import store

# Seven recorded responses; the follow-up chains to the first call and
# outlives the six that were deleted.
RECORDED = [
    ("warm-up", None, 1790884386.0, 1334, 192),
    ("m1", None, 1790884390.0, 1342, 136),
    ("m2", None, 1790884392.0, 1340, 104),
    ("m3", None, 1790884394.0, 1344, 110),
    ("m4", None, 1790884398.0, 1340, 232),
    ("m5", None, 1790884402.0, 1344, 120),
    ("follow-up", "m1", 1790884406.0, 1400, 100),
]


@pytest.fixture(scope="module")
def created(spark):
    return spark.createDataFrame(
        RECORDED,
        "response_id string, previous_response_id string, created_at double, "
        "input_tokens bigint, output_tokens bigint",
    ).withColumn("text", F.col("response_id"))


@pytest.fixture(scope="module")
def deleted(created):
    return created.where("response_id <> 'follow-up'").select("response_id")


def _ids(df):
    return sorted(r.response_id for r in df.collect())


def test_leaks_and_dangling(created, deleted):
    live = store.delete(created, deleted)
    assert _ids(live) == _ids(store.leak_audit(created, deleted)) == ["follow-up"]
    assert _ids(store.leak_ids(created, deleted)) == ["follow-up"]
    assert _ids(store.dangling_parents(live)) == ["follow-up"]
    assert _ids(store.dangling_parents(created)) == []


def test_retrieve_reports_misses(spark, created):
    ids = spark.createDataFrame([("m1",), ("gone",)], "response_id string")
    rows = {r.response_id: r for r in store.retrieve(ids, created).collect()}
    assert rows["m1"].found and rows["m1"].output_tokens == 136
    assert rows["m1"].created_ts is not None
    assert not rows["gone"].found and rows["gone"].output_tokens is None


def test_delete_of_unknown_ids_changes_nothing(spark, created):
    ids = spark.createDataFrame([("gone",)], "response_id string")
    assert store.delete(created, ids).count() == 7


def test_output_tokens(created):
    row = store.output_token_stats(created.where("response_id <> 'follow-up'")).first()
    assert (row.responses, row.min_tokens, row.max_tokens) == (6, 104, 232)


def test_first_stored(created):
    runs = created.withColumn("run", F.lit(1)).where("response_id LIKE 'm%'")
    assert store.first_stored(runs, ("run",), ("created_at", "response_id")).first().response_id == "m1"


def _forest(n, seed, hot):
    """Random trees, one long chain, one node with a third of all children, one lost parent."""
    random.seed(seed)
    parents = {0: None}
    for i in range(1, n):
        kind = i % 3
        if kind == 0:
            parents[i] = i - 3
        elif kind == 1:
            parents[i] = hot
        else:
            parents[i] = random.choice([None, -1] + list(range(i)))
    return parents


def _walk(parents):
    found = {}
    for node in parents:
        path, at = [], node
        while at is not None and at in parents:
            path.append(at)
            at = parents[at]
        found[node] = (path, at is not None)
    return found


@pytest.mark.parametrize("n,seed,cut", [(1, 1, {}), (300, 3, {}), (300, 4, {"share": 10, "floor": 0})])
def test_chain_links_and_context_in_trees(spark, n, seed, cut):
    parents = _forest(n, seed, hot=0)
    df = spark.createDataFrame(
        [(k, p, "x" * (k % 5 + 1)) for k, p in parents.items()],
        "response_id bigint, previous_response_id bigint, text string",
    )
    walked = _walk(parents)
    got = {r.response_id: r for r in store.chain_links(df, **cut).collect()}
    assert set(got) == set(parents)
    for node, (path, dangling) in walked.items():
        row = got[node]
        chars = sum(k % 5 + 1 for k in path)
        assert (row.root_id, row.depth, row.context_chars, row.dangling) == (
            path[-1], len(path) - 1, chars, dangling,
        )
    asked = {1000 + node: node for node in list(parents)[-20:]} | {5000: -7}
    follow_ups = spark.createDataFrame(
        list(asked.items()), "request_id bigint, previous_response_id bigint"
    )
    context = store.rebuild_context(follow_ups, df, **cut).collect()
    want = {
        (request, step, hops)
        for request, node in asked.items()
        if node in walked
        for hops, step in enumerate(walked[node][0], 1)
    }
    assert {(r.request_id, r.response_id, r.hops_back) for r in context} == want
    assert len(context) == len(want)


def test_a_circle_is_refused(spark):
    df = spark.createDataFrame(
        [(1, 2, "a"), (2, 1, "b"), (3, None, "c")],
        "response_id bigint, previous_response_id bigint, text string",
    )
    with pytest.raises(ValueError):
        store.chain_links(df)


def test_quantiles_are_exact_beyond_a_million_rows(spark):
    tokens = spark.range(2_000_000).select(F.lit("a").alias("role"), F.col("id").alias("output_tokens"))
    row = store.output_token_stats(tokens, ("role",)).first()
    assert (row.p50_tokens, row.p95_tokens) == (999_999, 1_899_999)


def test_outcome_per_deletion(spark):
    kept = spark.createDataFrame([(1,), (2,)], "response_id bigint")
    asked = spark.createDataFrame([(2,), (2,), (3,)], "response_id bigint")
    found = {r.response_id: r.outcome for r in store.delete_outcomes(kept, asked).collect()}
    assert found == {2: "deleted", 3: "not found"}
