"""Reports read in splits give the tables of whole files."""

from __future__ import annotations

import random

import pytest

from callscope.sources import reports

# The layout of the lines. Figures, ids and texts are invented.
PIECES = [
    "  MODEL: model-{n}  |  API: Chat",
    "  STEP 1 — Stored responses  |  model=model-{n}",
    "  CACHE PROOF — TTFT via streaming",
    "────────────────────────────",
    "",
    "   ",
    "",
    "  [warmup] priming cache bucket... {n} ms (cold write)",
    "  1      ALLOW     1525 ms        {n}         2176      98%",
    "  2      no label  1240 ms        2200         {n}      50%",
    "           response_id = resp_{n}",
    "  DELETED  resp_{n}",
    "    Run 1: TTFT={n} ms  total=1450 ms  [ALLOW]  iso=0a1b2c3d…",
    "  plain line {n}\x0b  MODEL: not-a-header",
    "  next\x85  MODEL: behind-a-line-end",
]


def _text(seed, lines):
    chance = random.Random(seed)
    weights = [1, 1, 1, 4, 8, 2, 2, 3, 20, 20, 5, 5, 5, 1, 1]
    return "\n".join(p.format(n=chance.randrange(1, 9999)) for p in chance.choices(PIECES, weights, k=lines))


PARSED = [reports.parse_call_rows, reports.parse_warmups, reports.parse_ttft_rows, reports.parse_store_events]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "4k"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def _same(spark, folder):
    whole, split = reports.read_reports(spark, folder), reports.read_split_reports(spark, folder)
    for parse in PARSED:
        got, want = parse(split), parse(whole)
        got = got.select(*want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty(), parse.__name__
    return split


def test_small_files(spark, tmp_path, small_splits):
    for n in range(12):
        text = ["", "\n\n", "\r\n \r\n"][n % 3] + _text(n, 40)
        text = text.replace("\n", "\r\n") if n % 4 == 1 else text
        (tmp_path / f"{n}.txt").write_text(text + ["", "\n"][n % 2], encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    _same(spark, str(tmp_path))


def test_a_long_file_uses_several_tasks(spark, tmp_path, small_splits):
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "long.txt").write_text(_text(77, 12_000), encoding="utf-8")
    _same(spark, str(tmp_path / "long"))
    assert spark.read.text(str(tmp_path / "long")).rdd.getNumPartitions() > 5
    # A section that spans many splits, with nothing known in between.
    long = "  MODEL: model-x  |  API: Chat\n" + "plain\n" * 200_000 + "\n" * 9 + PIECES[8].format(n=4)
    (tmp_path / "wide.txt").write_text(long, encoding="utf-8")
    assert spark.read.text(str(tmp_path / "wide.txt")).rdd.getNumPartitions() > 10
    row = reports.parse_call_rows(reports.read_split_reports(spark, str(tmp_path / "wide.txt"))).first()
    assert (row.section, row.header, row.input_tokens) == (0, "MODEL: model-x  |  API: Chat", 4)
