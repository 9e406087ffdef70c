"""Chains of stored responses that grow: roots and depths are kept, and a change reads only what it touches.

What :func:`callscope.operators.store.chain_links` finds by walking every chain is stored here and
brought up to date by the responses created and deleted since. Two tables lie in buckets: the links by their
root, so that a chain is in one bucket, and a directory by response id, which says in which chain a
response is, or which chain waits for a parent that is not stored. A change looks its ids and their parents up
in the directory, reads the buckets of the chains found, walks those that lost a response or
got a missing one, hangs the new ones on, and writes these buckets anew. A manifest names the valid
version of every bucket; writing it is the commit, after which replaced versions are removed. A change that
fails before leaves the old state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.store import _double, _moving
from callscope.session import committed, new_path, remove, written

LINKS = (
    "response_id", "previous_response_id", "own_chars", "root_id", "depth", "context_chars", "dangling",
)
DIRECTORY = ("id", "root_id", "awaited")


class Lineage:
    """The stored lineage below ``path``, in ``buckets`` buckets per table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # Storage

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, dict[tuple[str, int], int]]:
        """The last committed version, and that of every bucket."""
        found = committed(self.spark, f"{self.path}/manifest", "version")
        if not found:
            return -1, {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={found[-1]}").collect()
        return found[-1], {(r["kind"], r["bucket"]): r["of"] for r in rows}

    def _read(self, kind: str, like: DataFrame | None, buckets: list[int] | None = None) -> DataFrame | None:
        """Valid rows of a table in some buckets, or all."""
        _, of = self._manifest()
        names = [
            f"{self.path}/{kind}/version={v}/bucket={b}"
            for (k, b), v in of.items()
            if k == kind and (buckets is None or b in buckets)
        ]
        return self.spark.read.parquet(*names) if names else (None if like is None else like.limit(0))

    def links(self) -> DataFrame | None:
        """Root, depth and context size of every stored response; none before the first change."""
        found = self._read("links", None)
        if found is None:
            return None
        return found.select("response_id", "root_id", "depth", "context_chars", "dangling")

    def _touched(self, rows: DataFrame, column: str) -> list[int]:
        """The buckets of some ids: ``buckets`` numbers at most come to the driver."""
        return [r["b"] for r in rows.select(self._bucket(column).alias("b")).distinct().collect()]

    # Changes

    def change(self, created: DataFrame, deleted: DataFrame | None = None, text: str = "text") -> None:
        """Bring the lineage up to date.

        ``created`` has ``response_id, previous_response_id`` and the text, ``deleted`` has ``response_id``.
        Ids that are not stored change nothing; an id that is created again replaces its response, and
        one that is in both is created.
        """
        version, valid = self._manifest()
        scratch: list[str] = []

        def hold(df: DataFrame, name: str) -> DataFrame:
            path = new_path(self.spark, f"lineage-{name}")
            scratch.append(path)
            return written(df, path)

        new = hold(
            created.select(
                "response_id",
                "previous_response_id",
                F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("own_chars"),
            ),
            "created",
        )
        ids = new.select(F.col("response_id").alias("id"))
        gone = ids.limit(0) if deleted is None else deleted.select(F.col("response_id").alias("id"))
        parents = new.where("previous_response_id IS NOT NULL").select(F.col("previous_response_id").alias("id"))
        wanted = hold(
            ids.select("id", F.lit("new").alias("why"))
            .union(gone.select("id", F.lit("gone")))
            .union(parents.select("id", F.lit("parent")))
            .distinct(),
            "wanted",
        )
        empty = new.select(
            *LINKS[:3],
            F.col("response_id").alias("root_id"),
            F.lit(0).cast("bigint").alias("depth"),
            F.lit(0).cast("bigint").alias("context_chars"),
            F.lit(False).alias("dangling"),
        ).limit(0)
        directory = self._read(
            "directory",
            empty.select(F.col("response_id").alias("id"), "root_id", F.col("dangling").alias("awaited")),
            self._touched(wanted, "id"),
        )
        entries = hold(directory.join(wanted, "id"), "entries")
        # Chains that change: one of their responses goes or is replaced, or a parent they wait for comes.
        broken = hold(entries.where("why IN ('new', 'gone')").where("why = 'new' OR NOT awaited").select("root_id").distinct(), "broken")
        seen = entries.where("why = 'parent' AND NOT awaited").select("root_id").union(broken).distinct()
        near = self._read("links", empty, self._touched(seen, "root_id"))
        leaving = ids.union(gone).distinct().withColumnRenamed("id", "response_id")
        old = hold(near.join(broken, "root_id", "left_semi").select(*LINKS), "old")
        kept = old.join(leaving, "response_id", "left_anti")
        rows = hold(kept.select(*LINKS[:3]).union(new.dropDuplicates(["response_id"])), "rows")

        # Parents are among the rows to walk, or known in a chain that stays as it is.
        known = near.join(broken, "root_id", "left_anti").select(
            F.col("response_id").alias("up"), F.struct("root_id", "depth", "context_chars", "dangling").alias("seed")
        )
        walked = rows.select(F.col("response_id").alias("up"), F.lit(True).alias("walked"))
        base = (
            rows.withColumnRenamed("previous_response_id", "up")
            .join(walked, "up", "left")
            .join(known, "up", "left")
        )
        inside = F.col("walked").isNotNull()
        first = base.select(
            F.col("response_id").alias("id"),
            F.when(inside, F.col("up")).alias("up"),
            F.when(inside, F.col("response_id")).otherwise(F.coalesce("seed.root_id", "response_id")).alias("root"),
            F.when(inside, 1).otherwise(F.coalesce(F.col("seed.depth") + 2, F.lit(1))).cast("bigint").alias("links"),
            F.when(inside, F.col("own_chars")).otherwise(F.col("own_chars") + F.coalesce("seed.context_chars", F.lit(0))).alias("chars"),
            F.when(inside, False)
            .otherwise(F.coalesce("seed.dangling", F.col("up").isNotNull()))
            .alias("dangling"),
        )
        links = hold(first, "round")
        for _ in range(links.count().bit_length() + 2):
            if _moving(links).isEmpty():
                break
            links = hold(_double(links), "round")
        else:
            raise ValueError("responses refer to each other in a circle")
        made = hold(
            rows.join(
                links.select(
                    F.col("id").alias("response_id"),
                    F.col("root").alias("root_id"),
                    (F.col("links") - 1).alias("depth"),
                    F.col("chars").alias("context_chars"),
                    "dangling",
                ),
                "response_id",
            ).select(*LINKS),
            "made",
        )

        # Buckets with anything that goes or comes are written anew.
        roots = self._touched(made.select("root_id").union(broken), "root_id")
        stays = self._read("links", empty, roots).join(broken, "root_id", "left_anti").select(*LINKS)
        self._write("links", stays.union(made), "root_id", version + 1)
        before, after = self._entries(old), self._entries(made)
        places = self._touched(before.union(after), "id")
        listed = self._read("directory", after, places).select(*DIRECTORY)
        others = listed.join(before.select("id", "root_id", "awaited"), list(DIRECTORY), "left_anti")
        self._write("directory", others.union(after), "id", version + 1)
        self._commit(version + 1, valid, {"links": roots, "directory": places})
        for path in scratch:
            remove(self.spark, path)

    @staticmethod
    def _entries(links: DataFrame) -> DataFrame:
        """Directory rows of some links; a dangling root also under the parent it waits for."""
        stored = links.select(F.col("response_id").alias("id"), "root_id", F.lit(False).alias("awaited"))
        waits = links.where("dangling AND response_id = root_id").select(
            F.col("previous_response_id").alias("id"), "root_id", F.lit(True).alias("awaited")
        )
        return stored.union(waits)

    def _write(self, kind: str, rows: DataFrame, by: str, version: int) -> None:
        dealt = rows.withColumn("bucket", self._bucket(by)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/version={version}")

    def _commit(self, version: int, valid: dict, touched: dict[str, list[int]]) -> None:
        """Name the new versions of the touched buckets; then remove what they replace."""
        after = {(kind, b): v for (kind, b), v in valid.items() if b not in touched[kind]}
        for kind in touched:
            for bucket in committed(self.spark, f"{self.path}/{kind}/version={version}", "bucket", done=False):
                after[kind, bucket] = version
        rows = [(kind, b, v) for (kind, b), v in after.items()]
        frame = self.spark.createDataFrame(rows, "kind string, bucket int, of int")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        for (kind, b), v in valid.items():
            if after.get((kind, b)) != v:
                remove(self.spark, f"{self.path}/{kind}/version={v}/bucket={b}")
        if version:
            remove(self.spark, f"{self.path}/manifest/version={version - 1}")


def lineage_of(spark: SparkSession, changes: list[tuple[DataFrame, DataFrame | None]], buckets: int = 256) -> DataFrame:
    """The links after a sequence of changes (created, deleted), kept in a folder of their own."""
    kept = Lineage(spark, new_path(spark, "lineage"), buckets)
    reduce(lambda _, change: kept.change(*change), changes, None)
    return kept.links()
