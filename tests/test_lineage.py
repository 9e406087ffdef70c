"""A lineage kept up to date equals the walk over all chains."""

from __future__ import annotations

import os
import random

import pytest

from callscope.operators import store
from callscope.operators.lineage import Lineage
from callscope.session import new_path

ROWS = "response_id bigint, previous_response_id bigint, text string"


def _frame(spark, rows):
    return spark.createDataFrame(sorted(rows), ROWS)


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "response_id bigint")


def _same(lineage, spark, held):
    got = lineage.links()
    want = store.chain_links(_frame(spark, [(i, up, text) for i, (up, text) in held.items()]))
    assert got.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(*want.columns)).isEmpty()
    assert got.count() == len(held)


def test_changes_equal_the_full_walk(spark):
    """Trees grow, lose inner responses, get missing parents back and have responses replaced."""
    chance = random.Random(2)
    lineage = Lineage(spark, new_path(spark, "lineage-test"), 16)
    held: dict = {}
    for step in range(3):
        created = {}
        for n in range(step * 30, step * 30 + 30):
            earlier = [i for i in range(n) if i in held or i in created]
            up = chance.choice([None, *([chance.choice(earlier)] * 4 if earlier else []), 10_000 + n])
            created[n] = (up, chance.choice([None, "", "word " * chance.randrange(1, 9)]))
        if step == 2:  # parents that some wait for come, one response is replaced
            created |= {10_000 + n: (None, "late") for n in range(0, 60, 2)}
            created[5] = (None, "again")
        gone = chance.sample(sorted(held), len(held) // 6) + [77_777] if step else []
        lineage.change(_frame(spark, [(i, up, text) for i, (up, text) in created.items()]), _ids(spark, gone))
        held = {i: row for i, row in held.items() if i not in gone} | created
        _same(lineage, spark, held)


def test_only_touched_chains_are_read_and_written(spark):
    lineage = Lineage(spark, new_path(spark, "lineage-test"), 512)
    rows = [(c * 10 + n, c * 10 + n - 1 if n else None, "x") for c in range(100) for n in range(5)]
    lineage.change(_frame(spark, rows))
    _, before = lineage._manifest()
    lineage.change(_frame(spark, [(35, 34, "y"), (5_000, None, "z")]), _ids(spark, [72]))
    _, after = lineage._manifest()
    new = [key for key, version in after.items() if version == 1]
    assert len(after) >= len(before) - 8 and 4 <= len(new) <= 16
    held = {i: (up, text) for i, up, text in rows if i != 72} | {35: (34, "y"), 5_000: (None, "z")}
    _same(lineage, spark, held)
    # Of the first version just the buckets still valid are left.
    folder = lineage.path.removeprefix("file:")
    left = {int(b.split("=")[1]) for b in os.listdir(f"{folder}/links/version=0") if b.startswith("bucket")}
    assert left == {b for (kind, b), v in after.items() if kind == "links" and v == 0}
    assert os.listdir(f"{folder}/manifest") == ["version=1"]


def test_a_change_that_fails_leaves_the_old_state(spark):
    lineage = Lineage(spark, new_path(spark, "lineage-test"), 8)
    assert lineage.links() is None
    held = {1: (None, "a"), 2: (1, "b"), 3: (9, "c")}
    lineage.change(_frame(spark, [(i, *row) for i, row in held.items()]))
    with pytest.raises(ValueError, match="circle"):
        lineage.change(_frame(spark, [(1, 2, "a")]))
    _same(lineage, spark, held)
    lineage.change(_frame(spark, []), _ids(spark, [1, 2, 3]))
    assert lineage.links() is None or lineage.links().isEmpty()
