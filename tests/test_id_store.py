"""Look-up and deletion by id on disk."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from callscope.operators import store
from callscope.operators.id_store import IdStore
from callscope.session import new_path


def _rows(spark, ids, text="x"):
    return spark.createDataFrame([(i, f"{text}{i}", 1.0) for i in ids], "response_id bigint, text string, created_at double")


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "response_id bigint")


def _texts(df):
    return {r.response_id: r.text for r in df.collect()}


def _files(kept):
    found = glob.glob(f"{kept.path.removeprefix('file:')}/**/*.parquet", recursive=True)
    return {name: os.stat(name).st_mtime_ns for name in found}


def test_a_look_up_reads_few_files_and_a_deletion_rewrites_none(spark):
    kept = IdStore(spark, new_path(spark, "id-store"), 256)
    rows = spark.range(20_000).select(
        F.col("id").alias("response_id"), F.concat(F.lit("x"), "id").alias("text"), F.lit(1.0).alias("created_at")
    )
    kept.append(rows)
    before = _files(kept)
    wanted = list(range(0, 20_000, 1000)) + [99_999]
    found = kept.find(_ids(spark, wanted))
    assert _texts(found) == {i: f"x{i}" for i in wanted[:-1]}
    assert len(before) == 256 and len(found.inputFiles()) <= 21
    got = {r.response_id: r.found for r in kept.retrieve(_ids(spark, wanted)).collect()}
    assert got == {i: i != 99_999 for i in wanted}
    outcomes = kept.delete(_ids(spark, [0, 1000, 99_999]))
    assert {r.response_id: r.outcome for r in outcomes.collect()} == {0: "deleted", 1000: "deleted", 99_999: "not found"}
    after = _files(kept)
    assert all(after[name] == at for name, at in before.items())
    assert set(_texts(kept.find(_ids(spark, wanted)))) == set(wanted[2:-1])


def test_versions_tombstones_and_compaction(spark):
    kept = IdStore(spark, new_path(spark, "id-store"), 4)
    assert kept.rows() is None
    with pytest.raises(ValueError, match="nothing"):
        kept.retrieve(_ids(spark, [1]))
    assert kept.delete(_ids(spark, [1])).first().outcome == "not found"
    kept.append(_rows(spark, range(10), "a"))
    kept.append(_rows(spark, [3, 4], "b"))
    kept.delete(_ids(spark, [4, 5]))
    kept.append(_rows(spark, [5], "c"))
    want = {i: f"a{i}" for i in (0, 1, 2, 6, 7, 8, 9)} | {3: "b3", 5: "c5"}
    for _ in range(2):
        assert _texts(kept.rows()) == want and kept.rows().columns == ["response_id", "text", "created_at"]
        kept.compact()
    assert kept._versions("rows") == (4, []) and kept._versions("gone") == (4, [])
    kept.delete(_ids(spark, [0]))
    kept.append(_rows(spark, [77], "d"))
    kept.compact()
    assert _texts(kept.rows()) == {i: t for i, t in want.items() if i} | {77: "d77"}


def test_failed_deletions_keep_their_rows(spark):
    kept = IdStore(spark, new_path(spark, "id-store"), 4)
    kept.append(_rows(spark, range(5)))
    calls = [(0, 200), (1, 503), (2, 404), (3, None), (1, 500), (4, 503), (4, 200), (9, 404)]
    asked = spark.createDataFrame(calls, "response_id bigint, status int")
    outcomes = {r.response_id: r.outcome for r in kept.delete(asked).collect()}
    assert outcomes == {0: "deleted", 1: "failed", 2: "deleted", 3: "deleted", 4: "deleted", 9: "not found"}
    assert set(_texts(kept.rows())) == {1}
    assert {r.outcome for r in store.delete_outcomes(kept.rows(), _ids(spark, [1])).collect()} == {"deleted"}
