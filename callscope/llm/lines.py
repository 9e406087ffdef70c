"""Lines that recur across documents, found by a sharded minimal perfect hash.

Method: every line's key is hashed to 128 bits, a place half and a mark half. The distinct
keys of at least ``min_docs`` documents are dealt into shards by their place half; a shard
is a minimal perfect hash (levels of bit arrays in which the keys without a rival set a
bit; a key's number is the rank of its bit) with compact arrays by that number: the mark
as fingerprint, the count of documents, the largest document id. A document then probes the arrays
of the shards its own hashes fall into. No line is joined and no text moves for that: probes are
hashes, and what comes back is the few that are to go. A key outside the index, as any
rarer line is, is told by its fingerprint (64 bits).

A shard holds about ``SHARD`` keys. A shard that many documents probe, because of a line
that a third of them hold, is copied to as many groups as keep each below ``PROBES`` probes.

Defined results: a null or empty text is one empty line; a line's key is the line without
ASCII blanks at both ends and A-Z lower-cased. Documents are told apart by ``doc_id``: rows of one id
count once and keep or lose the same lines; a null id is an id of its own, smaller than all others.
Repeated rows stay. Other columns pass through; of the name of a result they are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bounded, fresh, keep, with_columns

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys per shard and probes per group, about.
SHARD = 1 << 18
PROBES = 1 << 20
#: Bits per key that is left at a level.
GAMMA = 2

BLANKS = b" \t\n\x0b\x0c\r"

INDEX = "shard int, sizes array<int>, bits binary, marks binary, docs binary, owners binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed values: its shifts and multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _at(place: np.ndarray, mark: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall in the bit array of a level; two keys part at some level as both halves count."""
    turn = np.uint64(2 * level + 1)
    return (_mixed(_mixed(place + turn) ^ (mark * turn)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys, from bit arrays alone."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def of(cls, place: np.ndarray, mark: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(place):
            size = GAMMA * len(place)
            at = _at(place, mark, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = ~alone[at]
            place, mark = place[rest], mark[rest]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def number(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The number of each key; any number or -1 for what is no key."""
        found = np.full(len(place), -1, np.int64)
        open_, start = np.arange(len(place)), 0
        for level, size in enumerate(self.sizes):
            at = start + _at(place[open_], mark[open_], level, size)
            hit = self.bits[at]
            found[open_[hit]] = self.rank[at[hit]]
            open_, start = open_[~hit], start + size
        return found


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def hashes(lines: list[bytes], min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the lines whose key is long enough, and both halves of the keys' hashes."""
    at, digests = [], []
    for n, line in enumerate(lines):
        if len(line) >= min_chars:
            key = key_of(line)
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8")) >= min_chars):
                at.append(n)
                digests.append(xxhash.xxh3_128_digest(key))
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.array(at, np.int64), halves[:, 0], halves[:, 1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])]
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def line_hashes(docs: DataFrame, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the text, with ``place`` and ``mark`` of its distinct long keys."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            places, marks = [], []
            for value in texts.to_pylist():
                _, place, mark = hashes(value.encode("utf-8").split(b"\n") if value else [], min_chars)
                # Of equal places (of one key, as good as surely) the first is kept.
                place, first = np.unique(place, return_index=True)
                places.append(place)
                marks.append(mark[first])
            return [_lists(places), _lists(marks)]

        return work

    return with_columns(docs, text, [("place", "array<bigint>"), ("mark", "array<bigint>")], make, drop=text)


def _build(table: pa.Table) -> pa.Table:
    shard = table["shard"][0].as_py()
    place, mark = (np.asarray(table[c]).view(np.uint64) for c in ("place", "mark"))
    perfect = PerfectHash.of(place, mark)
    order = np.argsort(perfect.number(place, mark))
    owner = np.asarray(table["owner"])[order]
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()),
            "sizes": pa.array([perfect.sizes], pa.list_(pa.int32())),
            "bits": [np.packbits(perfect.bits).tobytes()],
            "marks": [mark[order].tobytes()],
            "docs": [np.asarray(table["docs"])[order].astype("<i8").tobytes()],
            "owners": [owner.astype("<i8").tobytes()],
        }
    )


def index(lines: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD) -> tuple[DataFrame, int]:
    """The shards over the keys of at least ``min_docs`` documents, and their number.

    ``lines`` has ``doc_id, place, mark``. The owner of a key is its largest document id.
    """
    each = lines.select("doc_id", F.explode(F.arrays_zip("place", "mark")).alias("key"))
    count = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    counted = each.groupBy(F.col("key.place").alias("place"), F.col("key.mark").alias("mark")).agg(
        count.alias("docs"), F.max("doc_id").alias("owner")
    )
    recurring = keep(counted.where(F.col("docs") >= min_docs), "recurring")
    shards = max(1, -(-recurring.count() // shard_keys))
    dealt = recurring.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    # Two ids at least hold a key, so its owner is an id.
    owned = dealt.select("shard", "place", "mark", "docs", F.coalesce("owner", F.lit(0)).alias("owner"))
    return keep(owned.groupBy("shard").applyInArrow(_build, INDEX), "line-index"), shards


def _probe(arrays: pa.Table, probes: pa.Table) -> pa.Table:
    """The probes that are in the index of their shard, with what it knows of them."""
    if arrays.num_rows and probes.num_rows:
        row = {c: arrays[c][0].as_py() for c in ("sizes", "bits", "marks", "docs", "owners")}
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
        perfect = PerfectHash(row["sizes"], bits)
        place, mark = (np.asarray(probes[c]).view(np.uint64) for c in ("place", "mark"))
        number = perfect.number(place, mark)
        known = np.flatnonzero(number >= 0)
        known = known[np.frombuffer(row["marks"], "<u8")[number[known]] == mark[known]]
        docs, owners = (np.frombuffer(row[c], "<i8")[number[known]] for c in ("docs", "owners"))
    else:
        known, docs, owners = (np.zeros(0, np.int64) for _ in range(3))
    hit = probes.select(["doc_id", "body", "place"]).take(pa.array(known))
    return hit.append_column("docs", pa.array(docs)).append_column("owner", pa.array(owners))


def probe(lines: DataFrame, shards: DataFrame, n_shards: int, probes: int = PROBES) -> DataFrame:
    """``doc_id, body, place, docs, owner`` of the keys of ``lines`` that the index holds."""
    # How often a shard is asked: the keys it holds by their documents, all other keys evenly.
    asked = lines.agg(F.coalesce(F.sum(F.size("place")), F.lit(0))).scalar()
    loads = shards.select("shard", "docs").mapInArrow(_loads, "shard int, load bigint")
    copies = keep(
        loads.select("shard", F.ceil((F.col("load") + asked / n_shards) / probes).cast("int").alias("copies")),
        "copies",
    )
    row = F.monotonically_increasing_id()
    each = lines.withColumn("row", row).select(
        "doc_id", "body", "row", F.explode(F.arrays_zip("place", "mark")).alias("key")
    )
    sent = each.select(
        "doc_id", "body", "row", "key.place", "key.mark", F.pmod("key.place", F.lit(n_shards)).cast("int").alias("shard")
    )
    copies = bounded(copies)  # one short row per shard
    sent = sent.join(copies, "shard").withColumn("copy", F.pmod("row", F.col("copies")).cast("int"))
    held = shards.join(copies, "shard").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    answers = held.drop("copies").groupBy("shard", "copy").cogroup(
        sent.select("shard", "copy", "doc_id", "body", "place", "mark").groupBy("shard", "copy")
    )
    return answers.applyInArrow(
        lambda a, b: _probe(a, b), "doc_id bigint, body bigint, place bigint, docs bigint, owner bigint"
    )


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loads = [int(np.frombuffer(d.as_py(), "<i8").sum()) for d in batch.column("docs")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), pa.array(loads, pa.int64())], names=["shard", "load"]
        )


def _without(docs: DataFrame, source: str, kept: str, min_chars: int) -> DataFrame:
    """``docs`` with the text kept and the counts, from a struct of text and places to drop."""

    def make():
        def work(rows: pa.Array) -> list[pa.Array]:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist()):
                text = text or ""
                gone = 0
                if drop:
                    lines = text.encode("utf-8").split(b"\n")
                    at, place, _ = hashes(lines, min_chars)
                    leave = set(at[np.isin(place, np.array(drop, np.int64).view(np.uint64))].tolist())
                    gone = len(leave)
                    n_lines.append(len(lines))
                    text = b"\n".join(x for n, x in enumerate(lines) if n not in leave).decode("utf-8")
                else:
                    n_lines.append(text.count("\n") + 1)
                texts.append(text)
                n_dropped.append(gone)
            return [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

        return work

    fields = [(kept, "string"), ("n_lines", "bigint"), ("n_dropped", "bigint")]
    return with_columns(docs, source, fields, make, drop=source)


def dedup_lines(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    kept: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    shard_keys: int = SHARD,
    probes: int = PROBES,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text without recurring lines as ``kept``.

    A line whose key has ``min_chars`` code points and occurs in ``min_docs`` documents stays
    only in the document of the largest id that holds it.
    """
    number, content = F.col(f"`{id}`").cast("bigint"), F.col(f"`{text}`")
    # A row is found again by its id and a hash of its text: equal rows fare alike.
    body = F.xxhash64(content)
    rows = docs.select(number.alias("doc_id"), body.alias("body"), content.alias("text"))
    lines = keep(line_hashes(rows, "text", min_chars), "lines")
    shards, n_shards = index(lines, min_docs, shard_keys)
    found = probe(lines, shards, n_shards, probes)
    going = found.where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    gone = keep(
        going.groupBy(F.col("doc_id").alias("_of"), F.col("body").alias("_in")).agg(
            F.collect_set("place").alias("_gone")
        ),
        "gone",
    )
    names = [*docs.columns, id, text, kept]
    of, inside, places, pair = (fresh(names, n) for n in ("of", "inside", "places", "pair"))
    gone = gone.select(F.col("_of").alias(of), F.col("_in").alias(inside), F.col("_gone").alias(places))
    joined = docs.join(gone, number.eqNullSafe(F.col(of)) & (body == F.col(inside)), "left")
    both = F.struct(content.alias("text"), F.col(places).alias("places")).alias(pair)
    return _without(joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], both), pair, kept, min_chars)
