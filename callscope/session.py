"""Session settings the operators count on, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Log timestamps are UTC; durations and time slices must not depend on the host.
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: small sides become broadcasts only after their real
    # size is known, and join partitions with a hot key are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A rank filter cuts every task's rows before the shuffle, whatever the rank.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    # Streamed sessions of one key are merged in every task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; cluster sizing stays with the caller."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="callscope-")
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table one job writes."""
    return f"{shared_dir(spark).rstrip('/')}/callscope/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no replay."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a path below the shared folder, and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def committed(spark: SparkSession, path: str, key: str, done: bool = True) -> list[int]:
    """The numbers n of the folders ``key=n`` in a folder, in order; only those a job has committed, if ``done``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = []
    for status in files.listStatus(folder) if files.exists(folder) else []:
        name, _, number = status.getPath().getName().partition("=")
        if name == key and (not done or files.exists(jvm.Path(status.getPath(), "_SUCCESS"))):
            numbers.append(int(number))
    return sorted(numbers)
