"""A corpus pipeline: quality, near duplicates, secrets, mixture, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import bpe, minhash, mixing, quality, secrets
from callscope.llm.common import bounded, keep, ready, table, word_count
from callscope.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of ``docs``."""
    ready(spark)
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: that with the smallest id.

    A row without an id comes after all others. Rows of one id are told apart by their texts;
    rows equal in both stay once. Rows without id and shingles all stay.
    """
    ready(spark)
    row = F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text")
    )
    groups = minhash.near_duplicates(docs.select(row.alias("row"), "text"), id="row")
    marks = groups.where("NOT row.none OR n_shingles > 0").groupBy("row").agg(
        F.max(F.col("row") != F.col("component_id")).alias("copy"), F.count("*").alias("rows")
    )
    marks = keep(marks.where("copy OR rows > 1"), "copies")
    marked = docs.withColumn("row", row).join(bounded(marks), "row", "left")
    once = marked.where("copy IS NULL")
    repeated = marked.where("NOT copy").dropDuplicates(["row"])
    return once.union(repeated).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in the texts masked; ``n_chars`` follows."""
    ready(spark)
    # Half of the documents, by a hash of their ids, stand for the versions of an earlier scan.
    found, _ = secrets.scan_in_waves(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    masked = found.withColumn("text", secrets.redacted(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: a document appears as often as it is taken."""
    ready(spark)
    return mixing.mix(docs, word_count(F.col("text"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    ready(spark)
    return bpe.encode_decode(docs.select("doc_id", "source", "text"), VOCABULARY, drop="text")


STAGES = [
    ("quality", accept),
    ("near_duplicates", deduplicate),
    ("secrets", redact),
    ("mix", mix),
    ("tokens", tokenize),
]

#: A classifier, MinHash and byte-pair encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
