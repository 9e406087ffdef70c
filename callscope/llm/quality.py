"""A quality classifier: a factorisation machine over words, structure and metadata.

Method: a document is a sparse vector: its distinct words hashed into 2^16 buckets, and
one-hot steps of structure statistics (shares of capitals, digits, marks and blanks,
repetition of words and lines, lengths) and of metadata (the recorded number of
characters). Its score is the logistic of bias + linear terms + low-rank pairwise
interactions; the interactions of all pairs take linear time by
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

The model is fitted on a bounded sample of labelled documents: the ``SAMPLE`` ids with
the smallest hash among those with a document whose crc32(id as text) mod 5 is not 0, one row of each. Only their sparse
features reach the driver. Scoring reads every whole text where it lies; the
model (about 2.5 MB at any size of the corpus) travels with the tasks.

Defined results: a null or empty text is scored by its structure like any other;
without any usable label every score is 0.5; a label row with a null id or label is left out;
repeated rows get equal scores; other columns are kept.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import fresh, keep, released, with_columns

BUCKETS = 1 << 16
RANK = 8
SAMPLE = 12_000
EPOCHS = 6
#: Steps of 64 documents that a small sample is given at least.
STEPS = 800
ACCEPT = 0.3
MEMORY = 400_000

# Steps of the structure statistics; each interval is a feature of its own.
SHARE = (0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
LENGTH = tuple(float(2**k) for k in range(18))
MEAN = (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0)
STATISTICS = (
    ("capitals", SHARE), ("digits", SHARE), ("marks", SHARE), ("controls", SHARE), ("foreign", SHARE),
    ("distinct", SHARE), ("commonest", SHARE), ("pairs", SHARE), ("lines", SHARE), ("marked", SHARE),
    ("word", MEAN), ("words", LENGTH), ("line", LENGTH), ("longest", LENGTH), ("recorded", LENGTH),
)
WIDTH = BUCKETS + sum(len(steps) + 2 for _, steps in STATISTICS)

#: Class of each byte: 0 letter, 1 capital, 2 digit, 3 mark, 4 blank, 5 control, 6 beyond ASCII.
CLASSES = np.array(
    [
        6 if b >= 128 else 1 if 65 <= b <= 90 else 0 if 97 <= b <= 122 else 2 if 48 <= b <= 57
        else 4 if b in (9, 10, 13, 32) else 5 if b < 32 or b == 127 else 3
        for b in range(256)
    ],
    np.uint8,
)


class Features:
    """Sparse features of texts; remembers the buckets of words."""

    def __init__(self):
        self.buckets: dict[str, int] = {}
        self.first = {}
        at = BUCKETS
        for name, steps in STATISTICS:
            self.first[name] = at
            at += len(steps) + 2

    def _place(self, name: str, steps: tuple[float, ...], value: float | None) -> int:
        """The feature of a statistic's interval; the last one stands for no value."""
        step = len(steps) + 1 if value is None else int(np.searchsorted(steps, value, "right"))
        return self.first[name] + step

    def of(self, text: str | None, recorded: int | None) -> tuple[list[int], int]:
        """All features, word buckets first, and how many those are."""
        text = text or ""
        if len(self.buckets) > MEMORY:
            self.buckets.clear()
        data = text.encode("utf-8", "surrogatepass")
        kinds = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=7)
        words = text.split()
        distinct = set(words)
        for word in distinct.difference(self.buckets):
            self.buckets[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        found = sorted({self.buckets[w] for w in distinct})
        lines = [x for x in text.split("\n") if x]
        n, size = max(len(words), 1), max(len(data), 1)
        pairs = len(set(zip(words, words[1:])))
        ordered = sorted(words)
        codes = np.fromiter(map(self.buckets.__getitem__, ordered), np.int64, len(words))
        runs = np.diff(np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]) if words else np.zeros(1)
        values = {
            "capitals": kinds[1] / max(kinds[0] + kinds[1], 1),
            "digits": kinds[2] / size,
            "marks": kinds[3] / size,
            "controls": kinds[5] / size,
            "foreign": kinds[6] / size,
            "distinct": len(distinct) / n,
            "commonest": runs.max() / n,
            "pairs": pairs / max(len(words) - 1, 1),
            "lines": len(set(lines)) / max(len(lines), 1),
            "marked": sum(not w[-1].isalnum() for w in words) / n,
            "word": len(text) / n,
            "words": float(len(words)),
            "line": len(text) / max(len(lines), 1),
            "longest": float(max(map(len, distinct), default=0)),
            "recorded": None if recorded is None else float(recorded),
        }
        count = len(found)
        found += [self._place(name, steps, values[name]) for name, steps in STATISTICS]
        return found, count

    def batch(self, texts: list, recorded: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all texts in flat arrays, with offsets."""
        each = [self.of(t, r) for t, r in zip(texts, recorded)]
        index = np.array([i for found, _ in each for i in found], np.int64)
        value = np.concatenate(
            [np.r_[np.full(k, 1 / np.sqrt(max(k, 1))), np.ones(len(f) - k)] for f, k in each]
        ).astype(np.float32)
        return index, value, np.r_[0, np.cumsum([len(f) for f, _ in each])]


@dataclass
class Machine:
    """Bias, linear weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index, value, offsets):
        """Score before the logistic, and the sums the gradient needs."""
        starts = offsets[:-1]
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        straight = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + straight + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, vx

    def score(self, index, value, offsets) -> np.ndarray:
        margin = self.margin(index, value, offsets)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Mini-batch AdaGrad on the logistic loss, both labels weighing the same; every pass
    over the rows is in a new order."""
    noise = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(WIDTH, np.float32), noise.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32))
    if not rows:
        return machine
    good = float(np.mean([y for *_, y in rows]))
    weight = {1.0: 0.5 / max(good, 0.01), 0.0: 0.5 / max(1 - good, 0.01)}
    epochs = max(epochs, -(-STEPS * 64 // len(rows)))
    linear_sum = np.full(WIDTH, 1e-2, np.float32)
    factor_sum = np.full((WIDTH, RANK), 1e-2, np.float32)
    for _ in range(epochs):
        order = noise.permutation(len(rows))
        for start in range(0, len(order), 64):
            part = [rows[i] for i in order[start : start + 64]]
            index = np.concatenate([r[0] for r in part])
            value = np.concatenate([r[1] for r in part])
            sizes = np.array([len(r[0]) for r in part])
            offsets = np.r_[0, np.cumsum(sizes)]
            margin, sums, vx = machine.margin(index, value, offsets)
            wrong = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.array([r[2] for r in part])
            wrong *= np.array([weight[r[2]] for r in part]) / len(part)
            wrong = np.repeat(wrong.astype(np.float32), sizes)
            machine.bias -= 0.05 * float(wrong[offsets[:-1]].sum())
            used, at = np.unique(index, return_inverse=True)
            step = wrong * value
            linear = np.bincount(at, step, len(used)).astype(np.float32) + 1e-6 * machine.linear[used]
            pull = step[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            factor = np.stack([np.bincount(at, pull[:, f], len(used)) for f in range(RANK)], axis=1)
            factor = factor.astype(np.float32) + 1e-6 * machine.factors[used]
            linear_sum[used] += linear * linear
            factor_sum[used] += factor * factor
            machine.linear[used] -= 0.1 * linear / np.sqrt(linear_sum[used])
            machine.factors[used] -= 0.05 * factor / np.sqrt(factor_sum[used])
    return machine


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text") -> Machine:
    """A machine fitted on at most ``sample`` labelled documents of the learning part."""
    usable = (
        labels.where(F.col(id).isNotNull() & F.col("quality").isin(0, 1) & ~held_out(id))
        .groupBy(id)
        .agg(F.max("quality").alias("quality"))
    )
    there = docs.select(id).distinct()
    chosen = keep(usable.join(there, id, "left_semi").orderBy(F.xxhash64(id), id).limit(sample), "sample")
    recorded = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    rows = docs.select(F.col(id), F.col(text).alias("text"), recorded.cast("bigint").alias("recorded")).join(
        F.broadcast(chosen), id
    )
    # One row of an id, which does not depend on their order.
    place = F.struct(F.xxhash64("text", "recorded").alias("hash"), "text", "recorded", "quality")
    rows = rows.groupBy(id).agg(F.min(place).alias("r")).select(id, "r.text", "r.recorded", "r.quality")

    def run(batches):
        features = Features()
        for batch in batches:
            for i, t, r, y in zip(*(batch.column(c).to_pylist() for c in (id, "text", "recorded", "quality"))):
                found, words = features.of(t, r)
                yield pa.RecordBatch.from_pydict(
                    {"id": [i], "found": [np.array(found, np.int32).tobytes()], "words": [words], "quality": [y]}
                )

    found = rows.mapInArrow(released(run), "id bigint, found binary, words bigint, quality bigint").collect()
    examples = []
    for row in sorted(found, key=lambda r: (r["id"], bytes(r["found"]))):
        index = np.frombuffer(row["found"], np.int32).astype(np.int64)
        value = np.ones(len(index), np.float32)
        value[: row["words"]] = 1 / np.sqrt(max(row["words"], 1))
        examples.append((index, value, float(row["quality"])))
    return fit(examples)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if at least ``ACCEPT``)."""
    both = fresh(docs.columns, "_both")
    recorded = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    paired = docs.withColumn(both, F.struct(F.col(f"`{text}`").alias("text"), recorded.cast("bigint").alias("recorded")))

    def make():
        features = Features()

        def work(pairs: pa.Array) -> list[pa.Array]:
            texts, known = (pairs.field(k).to_pylist() for k in (0, 1))
            return [pa.array(machine.score(*features.batch(texts, known)))]

        return work

    scored = with_columns(paired, both, [("score", "double")], make, drop=both)
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
