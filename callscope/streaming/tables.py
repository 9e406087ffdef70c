"""Summaries of a live call log, kept as a table that grows by one part per micro-batch.

A micro-batch writes what its own rows amount to, under its number: sums per window and key, or
stretches of calls per key. Parts add up in any order, so a row may come as late as it likes, and a
batch that runs again after a failure replaces its own part. A view merges the parts and never reads
the log. Folding parts together now and then keeps their number small; the folded part's name says
up to which batch it reaches, so a batch that comes again after that is known and left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from callscope.operators import cache
from callscope.session import committed, new_path, remove

Merge = Callable[[DataFrame], DataFrame]

SESSION = ("cache_key", "first_call_at", "last_call_at", "calls", "hits")

#: Groups a key's calls of one micro-batch are dealt into.
SALTS = 64


class Parts:
    """The table: ``part=<batch>`` folders, and ``upto=<batch>`` for folded ones."""

    def __init__(self, spark: SparkSession, path: str, merge: Merge):
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge

    def _folders(self) -> tuple[int, list[int]]:
        """The batch the folded part reaches to (-1 without one), and the later parts.

        Only what a job has committed counts.
        """
        last = max(committed(self.spark, self.path, "upto"), default=-1)
        return last, [n for n in committed(self.spark, self.path, "part") if n > last]

    def add(self, rows: DataFrame, batch: int) -> None:
        """Write a batch's part, in place of an earlier try."""
        if batch > self._folders()[0]:
            rows.write.mode("overwrite").parquet(f"{self.path}/part={batch}")

    def read(self) -> DataFrame | None:
        """All parts merged; none before the first."""
        last, parts = self._folders()
        paths = [f"{self.path}/upto={last}"] * (last >= 0) + [f"{self.path}/part={n}" for n in parts]
        return self.merge(self.spark.read.parquet(*paths)) if paths else None

    def fold(self) -> None:
        """Merge all parts into one and remove what it replaces."""
        last, parts = self._folders()
        if not parts:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/upto={parts[-1]}")
        gone = [f"part={n}" for n in parts] + [f"upto={last}"] * (last >= 0)
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")

    def follow(self, stream: DataFrame, summarize: Merge, checkpoint: str) -> StreamingQuery:
        """Read the log up, a part per micro-batch."""
        return (
            stream.writeStream.foreachBatch(lambda rows, batch: self.add(summarize(rows), batch))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def follow_once(self, stream: DataFrame, summarize: Merge) -> DataFrame:
        """The same to its end; what the table holds then."""
        self.follow(stream, summarize, new_path(self.spark, "parts-state")).awaitTermination()
        found = self.read()
        if found is None:  # the log was empty, so no batch has run
            nothing = self.spark.createDataFrame([], stream.schema)
            return self.merge(summarize(nothing))
        return found


def merge_health(parts: DataFrame) -> DataFrame:
    """Sums per window and key."""
    sums = ("calls", "errors", "hits", "latency_sum_ms")
    kinds = {c: parts.schema[c].dataType for c in sums}
    return parts.groupBy("window_start", "cache_key").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums])


def health_table(spark: SparkSession, path: str) -> Parts:
    """Cache health per window and key; rates by :func:`callscope.operators.cache.health_rates`."""
    return Parts(spark, path, merge_health)


def stretches(calls: DataFrame, retention: str, salts: int = SALTS) -> DataFrame:
    """Stretches of calls with no gap longer than the retention, per key and salt.

    A key's calls are dealt over all tasks, which only makes more and shorter stretches: two calls
    that follow each other within the retention lie in stretches that meet.
    """
    salt = F.pmod(F.xxhash64("call_id", "started_at"), F.lit(salts)).alias("salt")
    grouped = calls.groupBy("cache_key", salt, F.session_window("started_at", retention)).agg(
        F.max("started_at").alias("last_call_at"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("cached_tokens") > 0).alias("hits"),
    )
    return grouped.select(
        "cache_key", F.col("session_window.start").alias("first_call_at"), "last_call_at", "calls", "hits"
    )


def _joined(parts: DataFrame, retention: str, keys: list) -> DataFrame:
    """Stretches that meet within the retention, joined; per ``keys``."""
    along = Window.partitionBy("cache_key", *keys).orderBy("first_call_at", "last_call_at")
    reach = F.max("last_call_at").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first_call_at") > reach + F.expr(f"INTERVAL {retention}"), F.lit(True))
    number = F.sum(F.col("_apart").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    numbered = parts.withColumn("_apart", apart).withColumn("_number", number)
    return numbered.groupBy("cache_key", *keys, "_number").agg(
        F.min("first_call_at").alias("first_call_at"),
        F.max("last_call_at").alias("last_call_at"),
        F.sum("calls").alias("calls"),
        F.sum("hits").alias("hits"),
    )


def merge_sessions(retention: str) -> Merge:
    """Stretches to sessions: first among those that start on one day, then per key."""

    def merge(parts: DataFrame) -> DataFrame:
        days = parts.withColumn("_day", F.to_date("first_call_at"))
        daily = _joined(days, retention, ["_day"]).drop("_number", "_day")
        return _joined(daily, retention, []).select(*SESSION)

    return merge


def session_table(spark: SparkSession, path: str, retention: str) -> Parts:
    """Warm sessions per key, however late their calls come."""
    return Parts(spark, path, merge_sessions(retention))
