"""Mixing sources to target weights by systematic sampling.

Method: every document expects target / size-of-its-source copies. Expected copies are
prefix-summed within the source, one random offset is added, and a document is
emitted once for every whole number its interval crosses. Sums are in fixed point
(2^-24 copies), so they do not depend on the order of addition. The order within a
source is by size first, then by a seeded digest of the id: neighbours in it are of
like size, which keeps the taken words near the target.

The prefix sum never gathers a source in one place. The order is cut into slices of
one size band (an eighth of an octave) and one of 256 digest ranges; slices are summed before
the shuffle, bands are summed up within a source (about 500 of them at most), digest
ranges within a band, and rows within a slice.

The table of sources itself (one row each) passes through one task.

Defined results: a null text has size 0; a null source is a source, ordered last; a
source without words has target 0 and none of its documents is taken; repeated rows
are documents of their own; rows equal in size and id get their places by the digest
of the text. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscope.llm.common import fresh, numbered

ONE = 1 << 24
DIGITS = 6  # hexadecimal digits that hold a number below ONE


def ranked(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``sizes`` (``source, source_size``) with weights dealt in turn, by code point, null last."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    turn = (F.row_number().over(place) - 1) % len(cycle) + 1
    return sizes.withColumn("weight", F.element_at(weights, turn.cast("int")).cast("long"))


def targets(weighted: DataFrame, share: float = 1.5, limit: int = 2) -> DataFrame:
    """``source, source_size, weight`` with the ``target`` of each source.

    ``share`` of all sizes is split by weight; no target exceeds ``limit`` times its
    source's size, and what exceeds it goes to the others by weight, and so on. In
    order of limit per weight the limited sources come first, so the level at which
    the others meet is the highest one that any prefix leaves.
    """
    cap = F.col("source_size") * limit
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    free = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(
        F.sum(cap).over(before), F.lit(0)
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0)
    )
    levels = weighted.withColumn("_level", free / weight_left)
    level = F.max("_level").over(everything)
    return levels.withColumn(
        "target", F.least(cap.cast("double"), level * F.col("weight"))
    ).drop("_level")


def _digest(seed: str, *values: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[v.cast("string") for v in values]).cast("binary"))


def _band(size: Column) -> Column:
    """Size rounded down to an eighth of an octave, as a number that grows with it."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(
        bits * 8 + F.expr(f"shiftright(_size, length(bin(_size)) - 4) & 7")
    )


def copies(
    docs: DataFrame,
    size: Column,
    id: str = "doc_id",
    text: str | None = "text",
    source: str = "source",
    cycle: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies``, which replace
    columns of those names; all others pass through."""
    results = ("_size", "_source_size", "_target", "_copies")
    kept = [c for c in docs.columns if c.lower() not in results]
    given, names = numbered(docs.withColumn(fresh(docs.columns, "counted"), size))
    *_, counted = names.values()
    id, source = names[id], names[source]
    text = names[text] if text else None
    rows = given.withColumnRenamed(counted, "_size").withColumns(
        {
            "_named": F.col(f"`{source}`").isNotNull(),
            "_source": F.coalesce(F.col(f"`{source}`"), F.lit("")),
            "_band": _band(F.col("_size")),
            "_digest": _digest(seed, F.col(f"`{id}`")),
        }
    ).withColumn("_range", F.substring("_digest", 1, 2))
    key = ["_named", "_source"]
    slices = rows.groupBy(*key, "_band", "_range").agg(
        F.count("*").alias("_rows"), F.sum("_size").alias("_words")
    )
    named = F.when(F.col("_named"), F.col("_source")).alias("source")
    sources = slices.groupBy(*key).agg(F.sum("_words").alias("source_size"))
    rates = targets(ranked(sources.select(*key, named, "source_size"), cycle), share, limit)
    each = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)
    ).otherwise(F.lit(0))
    offset = F.conv(F.substring(_digest(seed, F.lit("offset"), F.col("_source")), 1, DIGITS), 16, 10)
    rates = rates.select(
        *key,
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        each.cast("long").alias("_each"),
        offset.cast("long").alias("_offset"),
    )

    def running(*by: str) -> Window:
        return Window.partitionBy(*key, *by).rowsBetween(Window.unboundedPreceding, -1)

    bands = slices.groupBy(*key, "_band").agg(F.sum("_rows").alias("_rows"))
    above = F.coalesce(F.sum("_rows").over(running().orderBy("_band")), F.lit(0))
    bands = bands.select(*key, "_band", above.alias("_above"))
    within = F.coalesce(F.sum("_rows").over(running("_band").orderBy("_range")), F.lit(0))
    starts = (
        slices.withColumn("_within", within)
        .join(bands, [*key, "_band"])
        .join(rates, key)
        .select(
            *key, "_band", "_range", "_source_size", "_target", "_each",
            (F.col("_offset") + (F.col("_above") + F.col("_within")) * F.col("_each")).alias("_start"),
        )
    )
    tie = [F.md5(F.col(f"`{text}`").cast("binary"))] if text else []
    inside = Window.partitionBy(*key, "_band", "_range").orderBy(
        "_size", "_digest", F.col(f"`{id}`"), *tie
    )
    end = F.col("_start") + F.sum("_each").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = rows.join(starts, [*key, "_band", "_range"]).withColumn("_end", end)
    whole = F.expr(f"shiftright(_end, {DIGITS * 4}) - shiftright(_end - _each, {DIGITS * 4})")
    return placed.withColumn("_copies", whole).select(
        *[F.col(names[c]).alias(c) for c in kept], *results
    )


def mix(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    sized = docs.withColumn(fresh(docs.columns, "counted"), size)
    given, names = numbered(sized)
    *own, counted = names.values()
    named = {k: names[options.get(k, default)] for k, default in (("id", "doc_id"), ("source", "source"))}
    text = options.get("text", "text")
    taken = copies(given, F.col(counted), **options | named | {"text": names[text] if text else None})
    repeated = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return repeated.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own)])
