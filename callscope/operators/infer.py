"""Batch classification by a model the caller supplies."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions import constants as K
from callscope.functions.text import extract_label
from callscope.operators.policy import Rule


class Reply(NamedTuple):
    """What one call came back with; ``error`` says why there is no text."""

    text: str | None
    input_tokens: int | None = None
    cached_tokens: int | None = None
    output_tokens: int | None = None
    error: str | None = None


Predict = Callable[[list[str]], Sequence[Reply]]

_COUNTS = ("input_tokens", "cached_tokens", "output_tokens")
_REPLY = (
    T.StructType()
    .add("response_text", "string")
    .add("input_tokens", "long")
    .add("cached_tokens", "long")
    .add("output_tokens", "long")
    .add("latency_ms", "decimal(18,2)")
    .add("error", "string")
)


def _send(predict: Predict, texts: list[str | None]) -> tuple[list[Reply], list[Decimal]]:
    """A reply and a latency per text; the texts of a list that fails are sent one by one."""
    started = time.perf_counter()
    try:
        replies = list(predict(texts))
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} texts")
    except Exception as failure:  # the run goes on, whatever the model raised
        if len(texts) > 1:
            each = [_send(predict, [text]) for text in texts]
            return [r for replies, _ in each for r in replies], [t for _, took in each for t in took]
        replies = [Reply(None, error=str(failure) or type(failure).__name__)]
    return replies, [Decimal(f"{(time.perf_counter() - started) * 1000:.2f}")] * len(texts)


def classify_batch(
    messages: DataFrame,
    make_predict: Callable[[], Predict],
    text: str = "text",
    batch_size: int = 64,
) -> DataFrame:
    """A call row per message: reply, label, token counts, latency, error.

    ``make_predict`` runs once per partition, in the worker, and returns the function
    that sends a list of texts: a client is built there, never pickled. When it raises, the
    texts of that list are sent again one by one, and what it raises then is the error of
    that text; a reply may also carry an error of its own. A call's latency is that of its
    list, or of the text where it was sent alone. The other columns pass through as Arrow arrays, untouched. A
    partition that is run again after a loss sends its messages again.
    """
    names = {f.name for f in _REPLY}
    kept = [f for f in messages.schema if f.name != text and f.name not in names]
    schema = T.StructType([*kept, *_REPLY])
    sent = messages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                replies, latencies = _send(predict, batch.column(len(kept)).to_pylist())
                good = [r.error is None for r in replies]
                arrays = [
                    pa.array([r.text if ok else None for r, ok in zip(replies, good)], pa.string()),
                    *[
                        pa.array([getattr(r, c) if ok else None for r, ok in zip(replies, good)], pa.int64())
                        for c in _COUNTS
                    ],
                    pa.array(latencies, pa.decimal128(18, 2)),
                    pa.array([r.error for r in replies], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=schema.names)

    replied = sent.mapInArrow(run, schema)
    return replied.withColumn(
        "label", F.when(F.col("error").isNull(), extract_label(F.col("response_text")))
    )


def rule_predictor(rules: Sequence[Rule]) -> Callable[[], Predict]:
    """A model stand-in that answers with the strictest verdict of the rules.

    It counts a character as a token and caches nothing. A null text hits no rule, as in the
    policy, and has no count.
    """

    plain = [(K.SEVERITY[rule.verdict], rule.verdict, rule.pattern) for rule in rules]
    default = K.DEFAULT_VERDICT

    def make() -> Predict:
        compiled = [(level, word, re.compile(pattern)) for level, word, pattern in plain]

        def answer(value: str | None) -> Reply:
            if value is None:
                return Reply(default, None, 0, 1)
            hits = [(level, word) for level, word, pattern in compiled if pattern.search(value)]
            word = max(hits)[1] if hits else default
            return Reply(word, len(value), 0, 1)

        return lambda texts: [answer(value) for value in texts]

    return make
