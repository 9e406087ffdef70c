"""Replies read by a table of layouts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from callscope.plans import views as V
from callscope.sources import layouts, replies

RAW = "call_id bigint, api string, status int, body string"


def test_known_layouts_equal_the_typed_parser(spark, sf_dir):
    raw = V.raw_replies(V.load_calls(spark, sf_dir))
    want = replies.parse_replies(raw)
    got = layouts.parse_by_layout(raw, layouts.layout_table(spark))
    same = got.select(*want.columns)
    assert same.exceptAll(want).isEmpty() and want.exceptAll(same).isEmpty()
    seen = {(r.api, r.layout) for r in got.where("error IS NULL").select("api", "layout").distinct().collect()}
    assert seen == {("chat", "chat"), ("responses", "responses")}


def test_a_third_layout_is_a_row(spark):
    third = layouts.Layout(
        "turns", "$.reply.turns", "$.reply.turns", False, "answer", None, None, "$.say", "$.cost.in", "$.cost.hit", "$.cost.out"
    )
    body = {"reply": {"turns": [{"type": "think", "say": "ALLOW"}, {"type": "answer", "say": "BL"}, {"type": "answer", "say": "OCK"}]},
            "cost": {"in": 7, "out": 3}}
    rows = [
        (1, "x", 200, json.dumps(body)),
        (2, "x", 200, json.dumps({"novel": 1})),
        (3, "x", 200, '{"choices": ['),
        (4, "x", 200, None),
        (5, "x", 503, json.dumps(body)),
        (6, "x", 200, json.dumps({"choices": None, "usage": 4})),
        (7, "x", 200, json.dumps({"choices": [], "usage": {"prompt_tokens": "many"}})),
        (8, "x", 200, "[1, 2]"),
    ]
    raw = spark.createDataFrame(rows, RAW)
    known = layouts.layout_table(spark)

    def read(table):
        columns = ("layout", "error", "response_text", "input_tokens", "cached_tokens", "output_tokens", "label")
        return {r.call_id: tuple(r[c] for c in columns) for r in layouts.parse_by_layout(raw, table).collect()}

    before, after = read(known), read(known.union(layouts.layout_table(spark, (third,))))
    assert before[1] == (None, "unknown layout", None, None, None, None, None)
    assert after[1] == ("turns", None, "BLOCK", 7, 0, 3, "BLOCK")
    assert after[2][1] == "unknown layout" and after[3][1] == after[4][1] == "malformed body"
    assert after[5][1] == "HTTP 503" and after[8][1] == "unknown layout"
    assert after[7] == ("chat", None, "", 0, 0, 0, "")
    assert {n: before[n] for n in range(2, 9)} == {n: after[n] for n in range(2, 9)}
    assert read(known.limit(0))[7][1] == "unknown layout"


def test_one_parse(spark):
    raw = spark.createDataFrame([(1, "x", 200, "{}")], RAW)
    parsed = layouts.parse_by_layout(raw, layouts.layout_table(spark))
    plan = parsed.where(F.col("error").isNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson(") + plan.lower().count("parse_json(") <= 1
