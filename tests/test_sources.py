"""Replies, request batches and report text."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from callscope.operators import layout
from callscope.sources import replies, reports, requests


def raw(spark, bodies, api="responses", status=200):
    rows = [(i, api, status, body, 12.5) for i, body in enumerate(bodies)]
    return spark.createDataFrame(
        rows, "call_id bigint, api string, status int, body string, latency_ms double"
    )


def item(kind, *parts):
    return {"type": kind, "content": [{"type": t, "text": x} for t, x in parts]}


def test_responses_layout(spark):
    bodies = [
        {"output": [item("reasoning", ("output_text", "block")), item("message", ("output_text", "al"), ("refusal", "x"), ("output_text", "low"))], "usage": {"input_tokens": 9, "input_tokens_details": {"cached_tokens": 3}, "output_tokens": 2}},
        {"output": [], "usage": None},
        {},
        {"output": [{"type": "message"}, item("message", ("output_text", "Review"))], "usage": {"input_tokens": 9}},
        {"output": [{"type": "message", "content": [{"type": "output_text"}]}], "usage": {"input_tokens_details": {}}},
        {"unknown": {"deep": [1]}, "output": None},
    ]
    got = replies.parse_responses(raw(spark, [json.dumps(b) for b in bodies])).orderBy("call_id")
    rows = [(r.response_text, r.label, r.input_tokens, r.cached_tokens, r.error) for r in got.collect()]
    assert rows == [
        ("allow", "ALLOW", 9, 3, None),
        ("", "", 0, 0, None),
        ("", "", 0, 0, None),
        ("Review", "REVIEW", 9, 0, None),
        ("", "", 0, 0, None),
        ("", "", 0, 0, None),
    ]


def test_chat_layout(spark):
    bodies = [
        {"choices": [{"message": {"content": "BLOCK"}}, {"message": {"content": "ALLOW"}}], "usage": {"prompt_tokens": 7, "prompt_tokens_details": {"cached_tokens": 6}}},
        {"choices": [{"message": {"content": None}}], "usage": {"prompt_tokens": 7, "prompt_tokens_details": None}},
        {"choices": []},
        {"choices": None, "usage": {}},
    ]
    got = replies.parse_chat(raw(spark, [json.dumps(b) for b in bodies], "chat")).orderBy("call_id")
    rows = [(r.label, r.input_tokens, r.cached_tokens) for r in got.collect()]
    assert rows == [("BLOCK", 7, 6), ("", 7, 0), ("", 0, 0), ("", 0, 0)]


def test_failures_keep_their_rows(spark):
    broken = ["", "not json", '{"output": [', None, "[1, 2"]
    got = replies.parse_replies(raw(spark, broken)).collect()
    assert [r.error for r in got] == ["malformed body"] * 5
    assert all(r.latency_ms == 12.5 and r.label is None and r.input_tokens is None for r in got)
    failed = replies.capture_errors(raw(spark, ["x" * 500, None], status=503)).collect()
    assert [r.error for r in failed] == ["HTTP 503"] * 2
    assert failed[0].error_body == "x" * 300


def test_usage_of_both_layouts(spark):
    both = raw(spark, ['{"usage": {"input_tokens": 5}}']).unionByName(
        raw(spark, ['{"usage": {"prompt_tokens": 6, "prompt_tokens_details": {"cached_tokens": 4}}}'], "chat")
    )
    got = {r.api: (r.input_tokens, r.cached_tokens) for r in replies.normalize_usage(both).collect()}
    assert got == {"responses": (5, 0), "chat": (6, 4)}


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(1, 1, "hé\n\"x\"", "key-a", None, None), (2, None, "plain", None, "9", "iso")]
    return spark.createDataFrame(
        rows,
        "msg_id bigint, prompt_version bigint, text string, cache_key string, "
        "previous_response_id string, isolation_key string",
    )


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame([(1, "rules")], "prompt_version bigint, text string")


def bodies(df):
    return {r.msg_id: json.loads(r.body) for r in df.collect()}


def test_responses_requests(messages, prompts):
    got = bodies(requests.build_responses_requests(messages, prompts, model="m", store=True))
    text = 'User message to classify: hé\n"x"'
    assert got[1] == {
        "model": "m",
        "input": [
            {"type": "message", "role": "system", "content": [{"type": "input_text", "text": "rules"}]},
            {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]},
        ],
        "max_output_tokens": 512,
        "store": True,
        "prompt_cache_key": "key-a",
    }
    assert len(got[2]["input"]) == 1 and got[2]["previous_response_id"] == "9"
    assert "prompt_cache_key" not in got[2]


def test_breakpoint_marks_the_prompt_only(messages, prompts):
    got = bodies(
        requests.build_responses_requests(
            messages, prompts, model="m", role="developer", breakpoint_mode="explicit",
            max_output_tokens=None, stream=False,
        )
    )
    system, user = got[1]["input"]
    assert system["role"] == "developer"
    assert system["content"][0]["prompt_cache_breakpoint"] == {"mode": "explicit"}
    assert "prompt_cache_breakpoint" not in user["content"][0]
    assert got[1]["stream"] is False and "max_output_tokens" not in got[1]


def test_chat_requests(messages, prompts):
    got = bodies(requests.build_chat_requests(messages, prompts, model="m", stream=True))
    assert got[1]["messages"][0] == {"role": "system", "content": "rules"}
    assert (got[1]["max_tokens"], got[1]["temperature"], got[1]["stream"]) == (512, 0, True)
    assert "prompt_cache_isolation_key" not in got[1]
    assert got[2]["prompt_cache_isolation_key"] == "iso"


def test_shards_of_a_hot_key_are_split(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.col("id").alias("msg_id"),
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.lit("cold/key")).alias("cache_key"),
        F.sha2(F.col("id").cast("string"), 256).alias("body"),
    )
    path = str(tmp_path / "shards")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "200k")
    try:
        requests.write_requests(rows, path)
    finally:
        spark.conf.unset(size)
    assert len(glob.glob(f"{path}/cache_key=hot/*.json")) > 3
    back = requests.read_requests(spark, path)
    assert back.count() == 40_000
    assert back.exceptAll(rows.select("msg_id", "body", "cache_key")).isEmpty()
    requests.write_requests(rows, path, max_records_per_file=10_000)
    assert len(glob.glob(f"{path}/cache_key=hot/*.json")) >= 4


def test_read_messages_from_json(spark, tmp_path):
    path = os.path.join(tmp_path, "m.json")
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"id": 7, "body": "hello", "other": 1}\n')
    got = requests.read_messages(spark, path, id_col="id", text_col="body", fmt="json").collect()
    assert [tuple(r) for r in got] == [(7, "hello")]


# The layout of the lines. Figures, ids and texts are invented.
REPORT = """
────────────────────────────
  MODEL: model-a  |  API: Chat
────────────────────────────
  [warmup] priming cache bucket... 3050 ms (cold write)

  Call 1: [ALLOW ]  1525 ms  [WARM (2.0× faster than cold)]  "May I park here?"

  Call   Label     Latency  Input tkns  Cached tkns  Cache %
  ──────────────────────────────────────────────────────────
  1      ALLOW     1525 ms        2210         2176      98%
  2      no label  1240 ms        2200         1100      50%

────────────────────────────
  STEP 1 — Stored responses  |  model=model-b
────────────────────────────
  [warmup] priming cache bucket... 4100 ms (cold write)
           response_id = resp_1
  1      BLOCK     2980 ms        2190            0       0%
  previous_response_id = resp_1
  New response_id   = resp_2
  DELETED  resp_1

════════════════════════════
  CACHE PROOF — TTFT via streaming
════════════════════════════
    Run 1: TTFT=1300 ms  total=1450 ms  [ALLOW]  iso=0a1b2c3d…
    Run write : TTFT=1210 ms  total=1390 ms  [ALLOW]  ← cache write (cold)
    Run read 1: TTFT=1045 ms  total=1180 ms  [ALLOW]  ← 1.2× faster than cold avg
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("reports")
    for name in ("a.txt", "b.txt"):
        (folder / name).write_text(REPORT, encoding="utf-8")
    return reports.read_reports(spark, str(folder))


def test_report_calls_and_warmups(lines):
    calls = reports.parse_call_rows(lines).where("report = 'a.txt'").orderBy("section", "call_no")
    assert [
        (r.section, r.call_no, r.label, r.latency_ms, r.input_tokens, r.cached_tokens, r.cache_pct)
        for r in calls.collect()
    ] == [
        (1, 1, "ALLOW", 1525, 2210, 2176, 98),
        (1, 2, "no label", 1240, 2200, 1100, 50),
        (2, 1, "BLOCK", 2980, 2190, 0, 0),
    ]
    warmups = reports.parse_warmups(lines).where("report = 'b.txt'").orderBy("section")
    assert [r.cold_latency_ms for r in warmups.collect()] == [3050, 4100]
    models = calls.select("section", reports.section_model(F.col("header")).alias("m")).distinct()
    assert sorted(tuple(r) for r in models.collect()) == [(1, "model-a"), (2, "model-b")]


def test_report_ttft_and_store(lines):
    rows = reports.parse_ttft_rows(lines).where("report = 'a.txt'").orderBy("line_no").collect()
    assert [(r.cond, r.tag, r.ttft_ms, r.total_ms) for r in rows] == [
        ("COLD", "1", 1300, 1450), ("WARM", "write", 1210, 1390), ("WARM", "read 1", 1045, 1180),
    ]
    events = reports.parse_store_events(lines).where("report = 'a.txt'").orderBy("line_no")
    assert [(r.event, r.response_id) for r in events.collect()] == [
        ("created", "resp_1"), ("followed", "resp_1"), ("created", "resp_2"), ("deleted", "resp_1"),
    ]


def test_layout(spark):
    table = spark.createDataFrame([("a", 1), ("long", None)], "name string, n int")
    assert layout.column_widths(table, ["name", "n"]).first().asDict() == {"name": 4, "n": 1}
    got = [r.line for r in layout.layout_lines(table, ["name", "n"]).collect()]
    assert sorted(got) == ["a     |  1", "long  |   "]
