"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import (
    bpe,
    dialogue,
    lines,
    minhash,
    mixing,
    nndescent,
    planes,
    quality,
    secrets,
    shards,
    spelling,
    templates,
    toplists,
)
from callscope.llm.common import ready, table, word_count
from callscope.llm.oracle import ORACLE
from callscope.llm.vectors import is_query, usable

__all__ = ["ORACLE", "QUERIES", "VOCABULARY"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(function: Query) -> Query:
    """Register a query under its function's name, with the session set up first."""

    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ready(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, VOCABULARY).drop("text"), VOCABULARY)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@query
def op1_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    counted = mixing.copies(rows, F.col("size"), text=None)
    return counted.select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("size")).alias("taken"),
    )


@query
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select(
        "doc_id", quality.held_out().alias("held_out"), "score", "predicted"
    )


@query
def op7_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Half of the documents, by a hash of their ids, stand for the versions of an earlier scan.
    found, _ = secrets.scan_in_waves(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    spans = F.array_join(secrets.listed(), ",")
    return found.select(
        "doc_id",
        *[F.size(f"{r.kind}_spans").cast("long").alias(f"n_{r.kind}") for r in secrets.RULES],
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


@query
def op4_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        shards.text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shards.shard(docs, 16, ties=("text_crc32",)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_bit_planes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = planes.new_folder(spark)
    planes.write(planes.encode(planes.ordered(docs), VOCABULARY, end=1), folder)
    return planes.crc32_of(planes.read(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_templates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return templates.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_top_lists(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    whole = vectors.select("vec_id", toplists.whole_numbers(F.col("embedding")).alias("vector"))
    asked = whole.where(is_query()).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return toplists.top_k(whole, asked, 10)


@query
def op2_nn_descent(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    vectors = rows.where(nonzero).select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where(is_query()).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return nndescent.neighbours(vectors, asked, 10)


@query
def op11_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def repair_report(conversations: DataFrame, size: int = dialogue.CHUNK) -> DataFrame:
    """Damage, then the report of the repair with the hash of the repaired rows, for every given conversation."""
    summed, repaired = dialogue.repair(dialogue.damage(conversations), size)
    given = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    hashed = dialogue.digests(repaired)
    known = F.struct(F.col("conv_id")).alias("key")  # equal also where both are null
    joined = (
        given.select("conv_id", known)
        .join(summed.select(known, *[c for c in summed.columns if c != "conv_id"]), "key", "left")
        .join(hashed.select(known, "repaired_sha256"), "key", "left")
    )
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )


@query
def op12_repair(spark, sf_dir):
    return repair_report(table(spark, sf_dir, "conversations"))


@query
def op13_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
