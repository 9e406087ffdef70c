"""Stored responses on disk, found and deleted by id without a look at the others.

Rows lie in buckets by a hash of their id, sorted within, with a Bloom filter on the id, so a
look-up opens the files of the buckets its ids fall into and skips in them what cannot hold
the id. Every append is a version of its own. A deletion writes tombstones beside the rows and rewrites none;
a row counts if it is the newest of its id and newer than its tombstone. Compaction,
apart from both, folds versions and tombstones into one and takes effect when it is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscope.operators import store
from callscope.session import committed, remove

ID = "response_id"

#: So many ids at most become a list in the scan's filter; more are joined only.
LISTED = 1000


class IdStore:
    """A store below ``path``, in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _versions(self, kind: str) -> tuple[int, list[int]]:
        """What compaction reaches to (-1 before the first), and the later versions."""
        base = max(committed(self.spark, f"{self.path}/rows", "upto"), default=-1)
        return base, [v for v in committed(self.spark, f"{self.path}/{kind}", "version") if v > base]

    def _next(self) -> int:
        base, rows = self._versions("rows")
        return max([base, *rows, *self._versions("gone")[1]]) + 1

    def _write(self, rows: DataFrame, folder: str) -> None:
        bucket = F.pmod(F.xxhash64(ID), F.lit(self.buckets)).cast("int")
        dealt = rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", ID)
        writer = dealt.write.mode("overwrite").partitionBy("bucket")
        writer.option(f"parquet.bloom.filter.enabled#{ID}", "true").parquet(f"{self.path}/{folder}")

    def _read(self, kind: str, buckets: list[int] | None) -> DataFrame | None:
        """Rows of some buckets, with the ``version`` they came with."""
        base, versions = self._versions(kind)
        folders = [f"{kind}/version={v}" for v in versions]
        if kind == "rows" and base >= 0:
            folders.append(f"rows/upto={base}")
        found = None
        for folder in folders:
            held = committed(self.spark, f"{self.path}/{folder}", "bucket", done=False)
            names = [f"{self.path}/{folder}/bucket={b}" for b in held if buckets is None or b in buckets]
            if names:
                part = self.spark.read.parquet(*names).withColumn("version", F.lit(int(folder.rpartition("=")[2])))
                found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        return found

    def append(self, rows: DataFrame) -> None:
        """Store responses; one of a known id replaces it."""
        self._write(rows, f"rows/version={self._next()}")

    def _valid(self, buckets: list[int] | None, ids: list | None = None) -> DataFrame | None:
        rows, gone = self._read("rows", buckets), self._read("gone", buckets)
        if rows is None:
            return None
        if ids is not None:
            rows = rows.where(F.col(ID).isin(ids))
        newest = Window.partitionBy(ID).orderBy(F.col("version").desc())
        rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        if gone is not None:
            last = gone.groupBy(ID).agg(F.max("version").alias("_gone"))
            rows = rows.join(last, ID, "left").where("_gone IS NULL OR _gone < version").drop("_gone")
        return rows.drop("version")

    def rows(self) -> DataFrame | None:
        """Everything stored; none before the first append."""
        return self._valid(None)

    def find(self, ids: DataFrame) -> DataFrame | None:
        """The stored rows of some ids; the numbers of their buckets and up to ``LISTED`` ids
        come to the driver."""
        wanted = ids.select(ID).distinct()
        bucket = F.pmod(F.xxhash64(ID), F.lit(self.buckets)).cast("int").alias("b")
        buckets = [r["b"] for r in wanted.select(bucket).distinct().collect()]
        few = [r[ID] for r in wanted.limit(LISTED + 1).collect()]
        rows = self._valid(buckets, few if len(few) <= LISTED else None)
        return None if rows is None else rows.join(wanted, ID, "left_semi")

    def retrieve(self, ids: DataFrame) -> DataFrame:
        """As :func:`callscope.operators.store.retrieve`."""
        found = self.find(ids)
        if found is None:
            raise ValueError("nothing has been stored yet")
        return store.retrieve(ids, found)

    def delete(self, ids: DataFrame) -> DataFrame:
        """Delete by id; what became of each id, see :func:`callscope.operators.store.delete_outcomes`."""
        found = self.find(ids)
        if found is None:
            found = self.spark.createDataFrame([], ids.select(ID).schema)
        version = self._next()
        self._write(store.delete_outcomes(found, ids), f"gone/tried={version}")
        outcomes = self.spark.read.parquet(f"{self.path}/gone/tried={version}").drop("bucket")
        self._write(outcomes.where("outcome = 'deleted'").select(ID), f"gone/version={version}")
        return outcomes

    def compact(self) -> None:
        """Fold all versions and tombstones into one."""
        base, versions = self._versions("rows")
        _, gone = self._versions("gone")
        if not versions and not gone:
            return
        last = self._next() - 1
        self._write(self.rows(), f"rows/upto={last}")
        for name in [f"rows/version={v}" for v in versions] + [f"gone/version={v}" for v in gone]:
            remove(self.spark, f"{self.path}/{name}")
        if base >= 0 and base != last:
            remove(self.spark, f"{self.path}/rows/upto={base}")
