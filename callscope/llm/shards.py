"""Contiguous shards of equal bytes, by a global prefix sum of sizes.

Method: rows are range-partitioned by id. Each partition's total of sizes is computed
first; the prefix sum of those totals gives every partition its start, and running
sums within the partition give every row the bytes before it. The line of all bytes
is cut at equal targets: a row goes to the shard that holds its middle byte.

Only totals pass through one task: one row per partition, whatever the number of rows.
The result does not depend on how the partitions were cut.

Defined results: a null text takes one byte, as an empty one does; rows are in order of
id (null first), then size, then checksum; repeated rows are rows of their own; an empty
table has no rows. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscope.llm.common import keep, numbered


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(docs: DataFrame, shards: int = 16, id: str = "doc_id", size: str = "size", ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (place in the shard).

    The broadcast tables have one row per partition and one per shard.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    given, names = numbered(docs.select(*[F.col(f"`{c}`") for c in kept]))
    size = names[size]
    order = [names[id], size, *[names[c] for c in ties]]
    parted = given.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parted = keep(parted, "parted")
    totals = parted.groupBy("_part").agg(F.sum(f"`{size}`").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parted.withColumn("_from", F.coalesce(F.sum(f"`{size}`").over(inside), F.lit(0)))
        .withColumn("_nth", F.coalesce(F.count("*").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_part")
    )
    middle = F.col("_bytes_before") + F.col("_from") + F.expr(f"`{size}` div 2")
    # In whole numbers; decimals as bytes times shards may exceed 64 bits.
    cut = F.floor(middle.cast("decimal(30,0)") * shards / F.col("_all").cast("decimal(30,0)"))
    rows = keep(
        placed.withColumn("shard", F.least(cut.cast("int"), F.lit(shards - 1)))
        .withColumn("_row", F.col("_rows_before") + F.col("_nth"))
        .select(*names.values(), "shard", "_row"),
        "numbered",
    )
    first = rows.groupBy("shard").agg(F.min("_row").alias("_first"))
    return rows.join(F.broadcast(first), "shard").select(
        *[F.col(n).alias(c) for c, n in names.items()], "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
