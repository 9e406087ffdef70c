from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callscope.operators import cache, infer, policy
from callscope.operators.policy import Rule

RULES = [
    Rule("a", "ALLOW", "fine"),
    Rule("b", "REVIEW", "maybe"),
    Rule("c", "BLOCK", "never"),
    Rule("b", "BLOCK", "ever"),
]
CASES = [
    ("fine", "ALLOW", ["a"]),
    ("fine maybe", "REVIEW", ["a", "b"]),
    ("maybe never", "BLOCK", ["b", "c"]),
    ("nothing", "ALLOW", []),
    ("", "ALLOW", []),
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(i, text, verdict) for i, (text, verdict, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "msg_id bigint, text string, want string")


def test_strictest_category_wins(messages):
    rows = policy.apply_policy(messages, RULES).orderBy("msg_id").collect()
    assert [(r.text, r.verdict, r.categories) for r in rows] == CASES
    assert messages.where(policy.policy_verdict(F.col("text"), RULES) != F.col("want")).isEmpty()


def test_no_rules_and_no_text(spark, messages):
    assert {r.verdict for r in policy.apply_policy(messages, []).collect()} == {"ALLOW"}
    none = spark.createDataFrame([(None,)], "text string")
    row = policy.apply_policy(none, RULES).first()
    assert (row.verdict, row.categories) == ("ALLOW", [])


def test_policy_tables_of_any_size(spark):
    table = spark.createDataFrame([tuple(r) for r in RULES], "category string, verdict string, pattern string")
    assert sorted(policy.read_policy(table)) == sorted(RULES)
    many = spark.range(1_500).select(
        F.lit("c").alias("category"), F.lit("ALLOW").alias("verdict"), F.col("id").cast("string").alias("pattern")
    )
    assert len(policy.read_policy(many)) == 1_500


def test_accuracy_and_confusion(spark):
    labelled = spark.createDataFrame([(1, "ALLOW"), (2, "BLOCK"), (3, "ALLOW"), (9, "ALLOW")], "msg_id bigint, label string")
    expected = spark.createDataFrame([(1, "ALLOW"), (2, "BLOCK"), (3, "BLOCK")], "msg_id bigint, expected string")
    row = policy.accuracy(labelled, expected, "msg_id").first()
    assert (row.items, row.right) == (3, 2)
    cells = {(r.expected, r.label): r["items"] for r in policy.confusion(labelled, expected, "msg_id").collect()}
    assert cells == {("ALLOW", "ALLOW"): 1, ("BLOCK", "BLOCK"): 1, ("BLOCK", "ALLOW"): 1}


def test_batch_uses_one_client_per_partition(messages):
    def make():
        import uuid

        client = uuid.uuid4().hex
        return lambda texts: [infer.Reply(f"ALLOW from {client}", 5, 3, 1) for _ in texts]

    spread = messages.repartition(3, "msg_id").withColumn("part", F.spark_partition_id())
    rows = infer.classify_batch(spread, make).collect()
    assert {r.label for r in rows} == {"ALLOW"}
    assert len({r.response_text for r in rows}) == len({r.part for r in rows}) > 1


def test_batch_failures_become_rows(messages):
    def make():
        def predict(texts):
            if "maybe never" in texts:
                raise TimeoutError("too slow")
            if "" in texts:
                raise KeyError()
            return [infer.Reply(text.upper(), len(text), 0, 1) for text in texts]

        return predict

    answered = infer.classify_batch(messages.withColumn("copy", F.col("text")), make, batch_size=1)
    rows = {r.text: r for r in answered.withColumnRenamed("copy", "text").collect()}
    assert rows["maybe never"].error == "too slow" and rows["maybe never"].label is None
    assert rows["maybe never"].input_tokens is None
    assert rows[""].error == "KeyError"
    assert rows["fine"].label == "FINE" and rows["fine"].error is None
    assert rows["fine"].input_tokens == 4
    assert all(r.latency_ms >= 0 for r in rows.values())


def test_batch_sends_lists_and_keeps_other_columns_as_they_are(spark):
    big = 2**53 + 1
    rows = [(i, f"text {i}", big if i % 2 else None, [i, None], "key") for i in range(10)]
    kinds = "msg_id bigint, text string, parent bigint, parts array<int>, cache_key string"
    messages = spark.createDataFrame(rows, kinds).coalesce(1)

    def make():
        def predict(texts):
            said = f"ALLOW {len(texts)}"
            replies = [infer.Reply(said, 100, 40, 2) for _ in texts]
            if "text 9" in texts:
                replies[texts.index("text 9")] = infer.Reply(None, error="HTTP 500")
            return replies

        return predict

    answered = infer.classify_batch(messages, make, batch_size=4)
    found = sorted(answered.collect(), key=lambda r: r.msg_id)
    assert [r.parent for r in found] == [r[2] for r in rows]
    assert [r.parts for r in found] == [r[3] for r in rows]
    assert [r.response_text for r in found[:9]] == ["ALLOW 4"] * 8 + ["ALLOW 2"]
    assert (found[9].error, found[9].label, found[9].input_tokens) == ("HTTP 500", None, None)
    rate = cache.hit_rate(answered).first()
    assert (rate.calls, rate.hits, rate.cached_tokens) == (9, 9, 360)


def test_rule_predictor_equals_the_policy(messages):
    rows = infer.classify_batch(messages, infer.rule_predictor(RULES)).collect()
    assert all(r.label == r.want for r in rows)


def test_null_text_costs_no_neighbour(spark):
    rows = [(i, None if i == 3 else f"never {i}") for i in range(10)]
    messages = spark.createDataFrame(rows, "msg_id bigint, text string").coalesce(1)
    found = {r.msg_id: r for r in infer.classify_batch(messages, infer.rule_predictor(RULES)).collect()}
    assert all(r.error is None for r in found.values())
    assert {i: (r.label, r.input_tokens) for i, r in found.items()} == {
        i: ("ALLOW", None) if i == 3 else ("BLOCK", 7) for i in range(10)
    }


def test_failed_lists_are_sent_one_by_one(spark):
    rows = [(i, f"text {i}") for i in range(10)]
    messages = spark.createDataFrame(rows, "msg_id bigint, text string").coalesce(1)

    def make():
        def predict(texts):
            if "text 3" in texts:
                raise TimeoutError("too slow")
            return [infer.Reply("ALLOW", 1, 0, 1) for _ in texts]

        return predict

    found = {r.msg_id: r for r in infer.classify_batch(messages, make, batch_size=4).collect()}
    assert {i: (r.label, r.error) for i, r in found.items()} == {
        i: (None, "too slow") if i == 3 else ("ALLOW", None) for i in range(10)
    }
    assert all(r.latency_ms >= 0 for r in found.values())
