"""Token ids in chunk files of compressed bit planes.

Method: the ids of consecutive documents form a chunk of about ``CHUNK`` ids (a
document is never split between chunks). A chunk is cut into blocks of ``BLOCK`` ids; in each
block, the ids' bits are transposed, so that bit k of all ids lies together. The
planes of equal k of all blocks are joined and compressed with zstandard, each
plane on its own; planes above the chunk's highest bit are left out. An index row per
chunk says where in its part the chunk starts, how many documents and ids it has, and
the sizes of its planes.

Parts are ranges of the document id, so parts, chunks and documents within are in
ascending order. Both tables are Parquet files that Spark commits, so a lost or
repeated task leaves no half-written chunk; the payload is not compressed again.
A document's global start is the sum of the parts before (one row per part), of the
chunks before in its part, and of the documents before in its chunk.

Defined results: documents without an id come first; repeated ids are documents of
their own, in an arbitrary but fixed order; a document without ids has a row of
length 0 in its chunk; an empty table gives no chunk.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscope.llm.bpe import MEMORY, WORD_END, WordIds
from callscope.llm.common import slices, with_columns
from callscope.session import new_path

#: Between a letter or digit and a mark that is no part of a contraction or special token.
JOINTS = re.compile(r"[&%#*$!.,;:?](?<=[A-Za-z0-9À-ÖØ-öø-ÿ].)")

#: Words that go through the library together.
TOGETHER = 200

BLOCK = 4096
CHUNK = 1 << 18
LEVEL = 3

CHUNKS = (
    "part int, chunk int, doc_ids array<bigint>, lengths array<bigint>, "
    "blocks int, planes array<binary>"
)


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids, lowest bit first; the last block is padded."""
    if not len(ids):
        return []
    padded = np.zeros(-(-len(ids) // BLOCK) * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    width = int(padded.max()).bit_length()
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return [
        packer.compress(np.packbits((padded >> np.uint32(k)).astype(np.uint8) & 1).tobytes())
        for k in range(width)
    ]


def from_planes(planes: list[bytes], blocks: int, count: int) -> np.ndarray:
    """The ids back; without a plane all of them are 0."""
    ids = np.zeros(blocks * BLOCK, np.uint32)
    opener = zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        bits = np.frombuffer(opener.decompress(plane), np.uint8)
        ids |= np.unpackbits(bits).astype(np.uint32) << np.uint32(k)
    return ids[:count]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    # A task has one core; the library's own threads would only compete for it.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Remembered(WordIds):
    """Looks every piece up once; only those not found are told apart and learnt."""

    def gather(self, words: list, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > MEMORY:
            self.clear()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self.learn(dict.fromkeys(words[k] for k in unknown))
            at[unknown] = [self.index[words[k]] for k in unknown]
        sizes = self.sizes[at]
        total = np.r_[0, np.cumsum(sizes)]
        flat = np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[flat], total[np.r_[0, np.cumsum(counts, dtype=np.int64)]]


@functools.lru_cache(maxsize=2)
def _remembered(path: str) -> Remembered:
    """The pieces this process has met, from task to task (``MEMORY`` of them at most, and a batch)."""
    tokenizer = _tokenizer(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def coded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Pieces of letters are a word each, and a word's last token shows that it ends
        # it: many of them go through the library as one text.
        letters = [p.isalpha() for p in pieces]
        words = [p for p, one in zip(pieces, letters) if one]
        found: list = []
        for start in range(0, len(words), TOGETHER):
            part = words[start : start + TOGETHER]
            ids = coded([" ".join(part)])[0]
            cuts = np.flatnonzero(ends[ids]) + 1
            # Letters unknown to the library make other words: those parts go piece by piece.
            found += np.split(ids, cuts[:-1]) if len(cuts) == len(part) else coded(part)
        rest = coded([p for p, one in zip(pieces, letters) if not one])
        of_words, of_rest = iter(found), iter(rest)
        each = [next(of_words if one else of_rest) for one in letters]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.concatenate([*each, np.zeros(0, np.int32)]), sizes

    return Remembered(ids_of)


def _pieces(text: str) -> list[str]:
    """What a text is encoded as, piece by piece; in lower case where that is surely the
    library's (Latin-1 without special tokens)."""
    try:
        text.encode("latin-1")
        text = text if "<|" in text else text.lower()
    except UnicodeEncodeError:
        pass
    return JOINTS.sub(r" \g<0>", text).replace("\n", " ").split(" ")


def encode(docs: DataFrame, path: str, end: int = 1, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text and the ``end`` id, in place of the text.

    The vocabulary's words end at white space, and a mark after a letter or digit begins
    a new word, so a text is the sequence of the pieces between blanks and such places;
    each distinct one is encoded once per Python process, which keeps it for later tasks.
    """

    def make():
        known = _remembered(path)

        def work(texts: pa.Array) -> list[pa.Array]:
            pieces, counts = [], []
            for value in texts.to_pylist():
                found = _pieces(value) if value else []
                pieces += found
                counts.append(len(found))
            flat, offsets = known.gather(pieces, counts)
            ended = np.insert(flat, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ended, pa.int32()))]

        return work

    return with_columns(docs, text, [(ids, "array<int>")], make, drop=text)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``part, doc_id, ids`` in order, as chunks."""
    part, number = None, 0
    doc_ids: list = []
    lengths: list[int] = []
    held: list[np.ndarray] = []

    def chunk() -> pa.RecordBatch:
        ids = np.concatenate(held).astype(np.uint32)
        blocks = -(-len(ids) // BLOCK)
        row = {
            "part": pa.array([part], pa.int32()),
            "chunk": pa.array([number], pa.int32()),
            "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())),
            "lengths": pa.array([list(lengths)], pa.list_(pa.int64())),
            "blocks": pa.array([blocks], pa.int32()),
            "planes": pa.array([to_planes(ids)], pa.list_(pa.binary())),
        }
        for kept in (doc_ids, lengths, held):
            kept.clear()
        return pa.RecordBatch.from_pydict(row)

    total = 0
    for batch in batches:
        for piece in slices(batch, 2):
            lists = piece.column(2)
            flat = np.asarray(lists.flatten())
            ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
            start = 0
            for p, doc, stop in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), ends):
                if held and (p != part or total >= CHUNK):
                    yield chunk()
                    number, total = (number + 1 if p == part else 0), 0
                part = p
                doc_ids.append(doc)
                lengths.append(int(stop - start))
                held.append(flat[start:stop])
                total += int(stop - start)
                start = stop
    if held:
        yield chunk()


def ordered(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """``docs`` in partitions that are ascending ranges of the id, each sorted."""
    return docs.repartitionByRange(F.col(f"`{id}`")).sortWithinPartitions(F.col(f"`{id}`"))


def write(coded: DataFrame, folder: str, id: str = "doc_id", ids: str = "ids") -> None:
    """Write ``coded``, whose partitions are ``ordered``, as ``folder/chunks`` and ``folder/index``.

    Texts are put in order before they are encoded: choosing the ranges takes a first
    pass over the rows, which should not encode them.
    """
    spark = coded.sparkSession
    rows = coded.select(
        F.spark_partition_id().alias("part"),
        F.col(f"`{id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{ids}`").cast("array<int>").alias("ids"),
    )
    chunks = rows.mapInArrow(_chunks, CHUNKS)
    chunks.write.option("compression", "none").parquet(f"{folder}/chunks")
    written = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    n_ids = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sized = written.select(
        "part",
        "chunk",
        F.element_at("doc_ids", 1).alias("first_doc_id"),
        F.size("doc_ids").alias("n_docs"),
        n_ids.alias("n_ids"),
        F.transform("planes", F.octet_length).alias("plane_bytes"),
    )
    before = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = sized.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    index.write.parquet(f"{folder}/index")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            start, doc_ids, lengths, blocks, planes = (c[row].as_py() for c in batch.columns)
            ends = np.cumsum(lengths)
            ids = from_planes(planes, blocks, int(ends[-1]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "start": pa.array(start + ends - np.array(lengths)),
                    "ids": pa.ListArray.from_arrays(
                        pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.view(np.int32))
                    ),
                }
            )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, from the files."""
    index = spark.read.parquet(f"{folder}/index").select("part", "chunk", "n_ids", "start")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    places = index.join(F.broadcast(starts), "part").select(
        "part", "chunk", (F.col("part_start") + F.col("start")).alias("start")
    )
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    located = chunks.join(places, ["part", "chunk"])
    return located.select("start", "doc_ids", "lengths", "blocks", "planes").mapInArrow(
        _open, "doc_id bigint, start bigint, ids array<int>"
    )


def crc32_of(rows: DataFrame, ids: str = "ids", crc: str = "ids_crc32") -> DataFrame:
    """``rows`` with the crc32 of the ids as little-endian unsigned 32-bit integers, in place of the ids."""

    def make():
        def work(lists: pa.Array) -> list[pa.Array]:
            flat = np.ascontiguousarray(lists.flatten(), "<u4")
            ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
            starts = np.r_[0, ends[:-1]]
            data = memoryview(flat.view(np.uint8))
            return [
                pa.array(np.asarray(pc.list_value_length(lists)).astype(np.int64)),
                pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
            ]

        return work

    return with_columns(rows, ids, [("n_tokens", "bigint"), (crc, "bigint")], make, drop=ids)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for one set of files, in the shared folder."""
    return new_path(spark, "token-ids")
