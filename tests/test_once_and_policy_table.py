"""Messages are sent once; policies of many rules equal rule-by-rule matching."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from callscope.operators import infer, once, policy, policy_table
from callscope.operators.infer import Reply
from callscope.operators.policy import Rule
from callscope.plans import views as V
from callscope.session import new_path


def counting(log, dies_at=None, fails_on=None):
    """A model that writes down what it was sent; it may take its process with it."""

    def make():
        def predict(texts):
            for text in texts:
                with open(f"{log}/{os.getpid()}", "a") as file:
                    file.write(f"{text}\n")
                if dies_at is not None and text == dies_at:
                    os._exit(3)
                if fails_on is not None and text == fails_on:
                    raise RuntimeError("no reply")
            return [Reply(f"BLOCK {t}", len(t or ""), 0, 1) for t in texts]

        return predict

    return make


def sent(log):
    lines = []
    for name in os.listdir(log):
        with open(f"{log}/{name}") as file:
            lines += file.read().splitlines()
    return lines


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def test_equal_texts_and_later_runs_send_nothing_again(spark, log, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = [(n, f"text {n % 20}", "x") for n in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, text string, label string")
    first = once.classify_once(frame, counting(log), ledger, "v1", batch_size=4)
    assert first.count() == 200 and len(sent(log)) == 20
    assert {(r.id, r.response_text) for r in first.collect()} == {(n, f"BLOCK text {n % 20}") for n in range(200)}
    assert first.where("label = 'BLOCK' AND input_tokens = length(response_text) - 6").count() == 200
    more = frame.union(spark.createDataFrame([(999, "new", "x"), (998, None, "x"), (997, "", "x")], frame.schema))
    second = once.classify_once(more, counting(log), ledger, "v1")
    assert second.count() == 203 and len(sent(log)) == 23
    assert once.classify_once(more, counting(log), ledger, "v2").count() == 203 and len(sent(log)) == 46
    assert once.classify_once(more.limit(0), counting(log), ledger, "v3").count() == 0 and len(sent(log)) == 46


def test_a_killed_worker_loses_one_list_at_most(spark, log, tmp_path):
    ledger = str(tmp_path / "ledger")
    frame = spark.createDataFrame([(f"text {n}",) for n in range(300)], "text string")
    with pytest.raises(Exception):
        once.classify_once(frame, counting(log, dies_at="text 150"), ledger, "v1", batch_size=5).count()
    before = sent(log)
    answered = {r.response_text.removeprefix("BLOCK ") for r in once.read_ledger(spark, ledger).collect()}
    assert answered and "text 150" not in answered
    assert once.classify_once(frame, counting(log), ledger, "v1", batch_size=5).where("label = 'BLOCK'").count() == 300
    again = sent(log)
    assert not any(again.count(text) > 1 for text in answered)
    # Besides what was answered, each task that was stopped had one list under way.
    assert len(again) - 300 <= 5 * 8 and len(before) - len(answered) <= 5 * 8


def test_a_repeated_task_reads_its_own_files(tmp_path, log):
    rows = [(f"m{n}", f"text {n}") for n in range(23)]
    answers = once.Answers(str(tmp_path / "ledger"), "run", 3)
    predict = counting(log)()

    def until_lost():
        yield from rows[:17]
        raise ConnectionError("executor lost")

    with pytest.raises(ConnectionError):
        once.send_part(until_lost(), predict, answers, "v1", 5)
    assert len(sent(log)) == 15
    assert once.send_part(iter(rows), predict, once.Answers(str(tmp_path / "ledger"), "run", 3), "v1", 5) == 8
    assert sorted(sent(log)) == sorted(text for _, text in rows)


def test_errors_are_rows_and_sent_again_later(spark, log, tmp_path):
    ledger = str(tmp_path / "ledger")
    frame = spark.createDataFrame([("a",), ("b",), ("c",)], "text string").coalesce(1)
    first = once.classify_once(frame, counting(log, fails_on="b"), ledger, "v1").collect()
    assert sorted((r.response_text or "", r.error or "", r.label or "") for r in first) == [
        ("", "no reply", ""), ("BLOCK a", "", "BLOCK"), ("BLOCK c", "", "BLOCK"),
    ]
    assert once.classify_once(frame, counting(log), ledger, "v1").where("error IS NULL").count() == 3
    assert sent(log).count("b") >= 2


def test_equals_classify_batch(spark, sf_dir):
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["doc_id", "label", "input_tokens", "cached_tokens", "error"]
    got = once.classify_once(documents, infer.rule_predictor(V.RULES), new_path(spark, "ledger"), "v1").select(*columns)
    want = infer.classify_batch(documents, infer.rule_predictor(V.RULES)).select(*columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 1000


@pytest.mark.parametrize(
    "pattern, literal, whole",
    [
        ("secret", "secret", True),
        ("(secret)", "secret", True),
        ("a[ ]word", "a word", True),
        ("a[ \n]word", "word", False),
        ("(?:key)+ab?c", "key", False),
        ("x(?i:abc)yz", "yz", False),
        ("one|other", None, False),
        ("(?i)secret", None, False),
        ("pre(one|two)fix", "pre", False),
        ("a.c", None, False),
        ("(abc)?de", "de", False),
        ("^start$", "start", False),
        ("", None, False),
    ],
)
def test_required_literals(pattern, literal, whole):
    assert policy_table.required_literal(pattern) == (literal, whole)


def test_every_match_contains_its_literal():
    chance = random.Random(9)
    for _ in range(3000):
        pattern = "".join(chance.choice(["a", "b", "ab", "(ab)", "(a|b)", "[ab]", "a+", "b?", "(?:ba){2}", "."]) for _ in range(5))
        literal, whole = policy_table.required_literal(pattern)
        for _ in range(5):
            text = "".join(chance.choice("ab") for _ in range(12))
            match = re.search(pattern, text)
            if literal and match:
                assert literal in match[0]
            if whole:
                assert bool(match) == (literal in text)


def test_policy_table_equals_rule_by_rule(spark, sf_dir):
    rules = [Rule(f"c{n % 7}", ["BLOCK", "REVIEW", "ALLOW"][n % 3], p) for n, p in enumerate(
        ["password", "secret|token", "api[_-]?key", "(?i)LICENSE", "[a-z0-9._]+@[a-z0-9]+", "th", "en[ \n]de", "zzz+", "e$", "copyright"]
    )]
    documents = V.table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id bigint, text string"))
    table = spark.createDataFrame([*rules, rules[0]], "category string, verdict string, pattern string")
    got = {r.doc_id: (r.verdict, r.categories) for r in policy_table.apply_policy_table(documents, table).collect()}
    want = {r.doc_id: (r.verdict, r.categories) for r in policy.apply_policy(documents, rules).collect()}
    assert got == want and len({v for v, _ in got.values()}) == 3


def test_cost_hardly_grows_with_the_rules(spark, sf_dir):
    texts = [r.text for r in V.table(spark, sf_dir, "documents").select("text").limit(200).collect()]
    few, many = (
        policy_table.Matcher(tuple(Rule("c", "BLOCK", f"key{n:05d}[0-9]") for n in range(count)) + (Rule("c", "BLOCK", "th[ ]en"),))
        for count in (10, 20_000)
    )
    for match in (few, many):
        for text in texts:
            match.hits(text)
    assert many.tried <= few.tried + 5 and few.tried <= 2 * len(texts)


def test_bad_rules_are_refused(spark):
    messages = spark.createDataFrame([("a",)], "text string")
    for row in [("c", "BLOCK", "(open"), ("c", "NEVER", "x")]:
        table = spark.createDataFrame([row], "category string, verdict string, pattern string")
        with pytest.raises((re.error, KeyError)):
            policy_table.apply_policy_table(messages, table)
    empty = spark.createDataFrame([], "category string, verdict string, pattern string")
    assert policy_table.apply_policy_table(messages, empty).first().verdict == "ALLOW"
