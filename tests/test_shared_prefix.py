"""The prefix all requests of a key share, against a plain comparison."""

from __future__ import annotations

import os
import random

from callscope.operators import cache


def test_equals_brute_force(spark):
    chance = random.Random(5)
    rows = []
    for key in [*range(40), None]:
        start = "".join(chance.choice("abé\U0001f600") for _ in range(chance.choice([0, 1, 7, 900])))
        for n in range(chance.randrange(1, 6)):
            rows.append((key, start + "".join(chance.choice("abé") for _ in range(chance.randrange(4))), "x"))
    rows += [(7, None, "x"), (50, None, "x"), (51, "", "x"), (51, "abc", "x"), (52, "same", "x"), (52, "same", "x")]
    frame = spark.createDataFrame(rows, "cache_key int, body string, requests string")
    found = {r.cache_key: (r.requests, r.shared_chars, r.shortest_chars) for r in cache.shared_prefix(frame).collect()}
    bodies: dict = {}
    for key, body, _ in rows:
        bodies.setdefault(key, []).extend([] if body is None else [body])
    want = {
        k: (len(b), len(os.path.commonprefix(b)) if b else None, min(map(len, b)) if b else None) for k, b in bodies.items()
    }
    assert {k: (n, s if n else None, m) for k, (n, s, m) in found.items()} == want


def test_one_aggregation(spark):
    frame = spark.createDataFrame([("k", "abc"), ("k", "abd")], "cache_key string, body string")
    plan = cache.shared_prefix(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
