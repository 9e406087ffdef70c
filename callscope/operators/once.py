"""Batch classification that sends a message once, whatever happens to the job.

A ledger holds every reply under the hash of its message and the version of the prompt. Messages
that it knows for this version are not sent; of equal messages one is. The rest is dealt to tasks by hash;
a task writes each list of replies to a file of its own as soon as it has them, and a file counts once it
bears its final name. A task that is run again after a loss reads its own files first, and a job
that is run again finds them in the ledger: at most the list that was under way is sent twice.
Replies with an error are kept for the job's own result only, so that a later job sends them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.text import extract_label
from callscope.operators.infer import Predict, _send
from callscope.operators.lookup import lookup

FILE = pa.schema(
    [
        ("message", pa.string()),
        ("version", pa.string()),
        ("response_text", pa.string()),
        ("input_tokens", pa.int64()),
        ("cached_tokens", pa.int64()),
        ("output_tokens", pa.int64()),
        ("latency_ms", pa.decimal128(18, 2)),
        ("error", pa.string()),
    ]
)
LEDGER = (
    "message string, version string, response_text string, input_tokens bigint, cached_tokens bigint, "
    "output_tokens bigint, latency_ms decimal(18,2), error string, run string"
)
REPLY = ("response_text", "input_tokens", "cached_tokens", "output_tokens", "latency_ms", "error")


def message_hash(text: Column) -> Column:
    """What names a message; a null one is not the empty one."""
    return F.sha2(F.concat(F.when(text.isNull(), "0").otherwise("1"), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder all machines reach, and the folder in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Answers:
    """The files of one task of one run: what is in them, and the next one."""

    def __init__(self, ledger: str, run: str, part: int):
        self.store, root = _store(ledger)
        self.folder = f"{root.rstrip('/')}/run={run}/part={part}"
        self.store.create_dir(self.folder, recursive=True)

    def known(self) -> set[str]:
        names = [f.path for f in self.store.get_file_info(fs.FileSelector(self.folder)) if not f.base_name.startswith("_")]
        return {m for name in names for m in pq.read_table(name, filesystem=self.store, columns=["message"])["message"].to_pylist()}

    def add(self, rows: pa.Table) -> None:
        name = uuid.uuid4().hex
        with self.store.open_output_stream(f"{self.folder}/_{name}") as file:
            pq.write_table(rows, file)
        self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}.parquet")


def send_part(
    rows: Iterator[tuple[str, str | None]], predict: Predict, answers: Answers, version: str, batch_size: int
) -> int:
    """Send a task's messages (hash and text) that its files do not hold yet; their number."""
    known, held, sent = answers.known(), [], 0

    def send() -> None:
        replies, latencies = _send(predict, [text for _, text in held])
        good = [r.error is None for r in replies]
        columns = {
            "message": [m for m, _ in held],
            "version": [version] * len(held),
            "response_text": [r.text if ok else None for r, ok in zip(replies, good)],
            **{
                c: [getattr(r, c) if ok else None for r, ok in zip(replies, good)]
                for c in ("input_tokens", "cached_tokens", "output_tokens")
            },
            "latency_ms": latencies,
            "error": [r.error for r in replies],
        }
        answers.add(pa.table(columns, schema=FILE))

    for message, text in rows:
        if message not in known:
            known.add(message)
            held.append((message, text))
            sent += 1
        if len(held) == batch_size:
            send()
            held = []
    if held:
        send()
    return sent


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All replies of all runs; an empty table before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(f"{LEDGER}, part int").parquet(ledger).drop("part")


def classify_once(
    messages: DataFrame,
    make_predict: Callable[[], Predict],
    ledger: str,
    version: str,
    text: str = "text",
    batch_size: int = 64,
    **cut: int,
) -> DataFrame:
    """A call row per message as of :func:`callscope.operators.infer.classify_batch`, each different
    text sent once per prompt version; the other columns pass through.

    ``ledger`` is a folder that all machines reach. The messages are sent while this is
    called; the result then reads the ledger. An error is the row of this run only. Speculative
    tasks would send twice, so they are refused.
    """
    spark = messages.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("speculative tasks would send messages twice")
    hashed = messages.withColumn("_message", message_hash(F.col(f"`{text}`")))
    texts = hashed.select(F.col("_message").alias("message"), F.col(f"`{text}`").cast("string").alias("text"))
    good = read_ledger(spark, ledger).where((F.col("version") == version) & F.col("error").isNull())
    new = texts.dropDuplicates(["message"]).join(good.select("message").distinct(), "message", "left_anti")
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m, t) for b in batches for m, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        answers = Answers(ledger, run_id, TaskContext.get().partitionId())
        sent = send_part(rows, make_predict(), answers, version, batch_size)
        yield pa.RecordBatch.from_pydict({"sent": pa.array([sent], pa.int64())})

    # Dealt by hash into a fixed number of tasks: a task that is run again has the same messages.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    new.repartition(tasks, "message").mapInArrow(run, "sent bigint").agg(F.sum("sent")).collect()

    answered = read_ledger(spark, ledger).where(
        (F.col("version") == version) & (F.col("error").isNull() | (F.col("run") == run_id))
    )
    # A reply counts before an error; of two replies to one message either will do, so the least.
    order = F.struct(F.col("error").isNotNull().alias("failed"), *REPLY)
    one = answered.groupBy(F.col("message").alias("_message")).agg(F.min(order).alias("_reply"))
    names = set(REPLY) | {"label", text}
    kept = [c for c in messages.columns if c not in names]
    called = lookup(hashed, one, "_message", "left", **cut).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"_reply.{c}").alias(c) for c in REPLY]
    )
    return called.withColumn("label", F.when(F.col("error").isNull(), extract_label(F.col("response_text"))))
