from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callscope.functions import fragments
from callscope.functions import text as X
from callscope.functions.registry import register

LABEL_CASES = [
    ("", ""),
    (None, ""),
    ("BLOCK", "BLOCK"),
    ("blocked", "blocked"),
    ("review or allow", "ALLOW"),
    ("allow, then block", "BLOCK"),
    ("not BLOCK, ALLOW", "BLOCK"),
    ("\n  \n  hello", "hello"),
    ("x" * 40, "x" * 30),
    ("a" + " " * 40 + "b", "a" + " " * 29),
    ("a" + " " * 40 + "\nb", "a"),
    ("_BLOCK", "_BLOCK"),
    ("éBLOCK", "éBLOCK"),
    ("BLOCKé", "BLOCKé"),
    ("BLOCK2", "BLOCK2"),
    ("BLOCK\u0301", "BLOCK"),
    ("x-block.", "BLOCK"),
    ("BLOC\u212a", "BLOCK"),
    ("REV\u0130EW", "REVIEW"),
    ("REV\u0131EW", "REVIEW"),
    ("«Review»", "REVIEW"),
    ("　 two words \x1c next", "two words"),
    ("\x1f\x85 line more", "line"),
    ("tab\there\x0bnext", "tab\there"),
    ("allowblock BLOCKallow", "allowblock BLOCKallow"),
    ("blockblock block", "BLOCK"),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, text, want) for i, (text, want) in enumerate(LABEL_CASES)]
    return spark.createDataFrame(rows, "id int, text string, want string")


def test_extract_label(cases):
    got = cases.withColumn("got", X.extract_label(F.col("text")))
    assert [r for r in got.collect() if r.got != r.want] == []


def test_extract_label_in_sql(spark, cases):
    register(spark)
    cases.createOrReplaceTempView("label_cases")
    wrong = spark.sql("SELECT * FROM label_cases WHERE extract_label(text) <> want")
    assert wrong.collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 40])
def test_label_from_pieces_equals_label_of_whole(spark, cases, size):
    """Texts cut into pieces of any size, merged left to right and as a tree."""
    more = [
        "  \n" * 9 + "first line that goes on for more than thirty characters\nALLO W",
        "a re" + "view" * 3 + " rev iew",
        "word " * 30 + "al" + "low",
        "x" * 29 + " " * 30 + "\n" + "review_",
        " " * 100,
        "block" * 7 + "\r\nblock",
        "🙂" * 35 + "\nBLOCKS",
    ]
    texts = [t or "" for t, _ in LABEL_CASES] + more
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    starts = F.sequence(F.lit(0), F.length("text"), F.lit(size))
    pieces = F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(size)))
    summaries = F.transform(pieces, fragments.summarize)
    left = F.reduce(summaries, fragments.empty(), fragments.merge)
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("s"), F.lit(2)),
        lambda i: F.when(
            i < F.size("s"), fragments.merge(F.element_at("s", i), F.element_at("s", i + 1))
        ).otherwise(F.element_at("s", i)),
    )
    tree = F.reduce(pairs, fragments.empty(), fragments.merge)
    got = df.withColumn("s", summaries).select(
        "id",
        "text",
        X.extract_label(F.col("text")).alias("want"),
        fragments.label_of(left).alias("left"),
        fragments.label_of(tree).alias("tree"),
        left["chars"].alias("chars"),
        F.length("text").alias("length"),
    )
    wrong = [
        r
        for r in got.collect()
        if not (r.want == r.left == r.tree and r.chars == r.length)
    ]
    assert wrong == []


def test_strict_format(spark):
    rows = [("BLOCK", True), ("ALLOW", True), ("allow", False), ("ALLOW.", False), ("ALLOW\n", False), (" ALLOW", False), (None, False)]
    df = spark.createDataFrame(rows, "text string, want boolean")
    got = df.where(X.strict_format(F.col("text")) != F.col("want"))
    assert got.collect() == []


def test_previews(spark):
    df = spark.createDataFrame([("é" * 121,), ("é" * 120,), ("",)], "text string")
    got = [r[0] for r in df.select(X.long_preview(F.col("text"))).collect()]
    assert got == ["é" * 120 + " … [121 chars stored in full]", "é" * 120, ""]
    assert df.select(X.preview(F.col("text"), 45)).first()[0] == "é" * 45


def test_flatten_content(spark):
    df = spark.sql(
        """SELECT 'plain' AS plain, CAST(NULL AS ARRAY<STRUCT<text STRING>>) AS parts
        UNION ALL SELECT NULL, array(struct('a'), struct(CAST(NULL AS STRING)), struct('b'))
        UNION ALL SELECT NULL, NULL"""
    )
    got = df.select(X.flatten_content(F.col("plain"), F.col("parts"))).collect()
    assert sorted(r[0] for r in got) == ["", "a  b", "plain"]
    assert df.select(X.item_role(F.lit(None).cast("string"))).first()[0] == "?"
