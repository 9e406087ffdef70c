"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.session import configure, new_path

#: A word: anything between blanks and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Text handled at once in a Python worker.
SLICE_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the subpackage: small Arrow batches, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Lost executors then cost no replay, several readers cost one computation, and
    the planner knows the real size of what it joins.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table of ``keep`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """``df``, to be broadcast in a join if it has at most ``rows`` rows; else the planner
    shuffles. For tables of ``keep`` with a few numbers a row (some MB at that bound)."""
    return F.broadcast(df) if df.count() <= rows else df


def word_count(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(columns: list[str], name: str) -> str:
    """``name``, or that with underscores in front until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns ``given_0, given_1, ...``, which no name of an operator's own can
    meet, and the new name of each old one."""
    names = {c: f"given_{n}" for n, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes in a column, one row at least."""
    values = batch.column(column)
    if pa.types.is_struct(values.type):  # its first field is the text
        values = values.field(0)
    nested = pa.types.is_list(values.type)
    sizes = pc.list_value_length(values) if nested else pc.binary_length(values)
    start, held = 0, 0
    for row, size in enumerate(sizes.to_pylist()):
        size = (size or 0) * (8 if nested else 1)
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, whose process gives the memory back that a task had: workers wait for the next task
    with what the last one left them."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return task


def with_columns(
    df: DataFrame,
    source: str,
    fields: list[tuple[str, str]],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    drop: str | None = None,
) -> DataFrame:
    """``df`` with new columns computed by numpy code from one column, in Arrow batches.

    ``make`` is called once per task and gives the function that turns the column's
    values of some rows into the new arrays. The other columns pass through as they
    are. A new column replaces an old one of its name; ``drop`` names a
    column that is not passed through.
    """
    names = {n.lower() for n, _ in fields}
    kept = [c for c in df.columns if c.lower() not in names and c != drop]
    given = kept if source in kept else [*kept, source]
    frame = df.select(*[F.col(f"`{c}`") for c in given])
    at, width = given.index(source), len(kept)
    added = [T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in fields]
    schema = T.StructType(frame.schema.fields[:width] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                arrays = part.columns[:width] + work(part.column(at))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return frame.mapInArrow(released(run), schema)
