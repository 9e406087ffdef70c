"""Sizes and layout of a text report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "  |  "


def column_widths(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Widest text per column, its heading included, as one row."""
    return table.agg(
        *[
            F.greatest(
                F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))
            )
            .cast("bigint")
            .alias(c)
            for c in columns
        ]
    )


def layout_lines(table: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows as text lines with every column padded to its width."""
    widths = column_widths(table, columns).select(F.struct(*columns)).scalar()
    # As a generated column the widths are one sub-query, not one per mention.
    beside = table.select("*", F.explode_outer(F.array(widths)).alias("_widths"))
    cells = [
        F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(f"_widths.{c}").cast("int"), F.lit(" "))
        for c in columns
    ]
    return beside.select(*keep, F.concat_ws(SEPARATOR, *cells).alias("line"))


def prompt_size(prompts: DataFrame, messages: DataFrame) -> DataFrame:
    """Characters of each prompt version, and how many messages go with it."""
    counts = messages.groupBy("prompt_version").agg(F.count(F.lit(1)).alias("messages"))
    sizes = prompts.select("prompt_version", F.length("text").cast("bigint").alias("prompt_chars"))
    return sizes.join(counts, "prompt_version", "left").withColumn(
        "messages", F.coalesce("messages", F.lit(0).cast("bigint"))
    )
