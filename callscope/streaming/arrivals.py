"""Time to first token of replies whose chunks arrive as a stream, one state per request.

The state of a request is what its chunks amount to so far: a summary of fixed size for
every run of neighbouring chunks, which is a single one unless chunks are out of order. A typed
reply is written in the batch that brings its completion event with all chunks before it; any other
once no chunk has come for ``idle`` of event time. A chunk that is sent again is known by its
number and changes nothing, before and after the reply was written. Then the state
is cleared by the same timer.

Neighbouring chunks of a request that lie in one Arrow batch of the log become one run before the
shuffle, so the state is asked once per run and not once per chunk. A run carries its text and the
times of its chunks: if some of them are known already, the others are cut out of it.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callscope.functions import constants as K
from callscope.functions import fragments
from callscope.operators import ttft

WORDS = tuple(K.LABELS)
LINE = ("text", "more", "open")


class Piece(NamedTuple):
    """A run of chunks ``low`` to ``high``; fields as in :mod:`callscope.functions.fragments`."""

    low: int
    high: int
    end_us: int | None
    token_us: int | None
    done: bool
    chunks: int
    head: str
    tail: str
    words: tuple[bool, ...]
    lead: tuple[str, bool, bool]
    line: tuple[str, bool, bool]
    chars: int


_LONG, _BOOLEAN, _STRING = T.LongType(), T.BooleanType(), T.StringType()
_STATE = T.StructType(
    [
        *[T.StructField(n, _LONG) for n in ("low", "high", "end_us", "token_us")],
        T.StructField("done", _BOOLEAN),
        T.StructField("chunks", _LONG),
        T.StructField("head", _STRING),
        T.StructField("tail", _STRING),
        *[T.StructField(word, _BOOLEAN) for word in WORDS],
        *[
            T.StructField(f"{of}_{part}", _STRING if part == "text" else _BOOLEAN)
            for of in ("lead", "line")
            for part in LINE
        ],
        T.StructField("chars", _LONG),
    ]
)
OUTPUT = T.StructType([T.StructField("request_id", _LONG), T.StructField("whole", _BOOLEAN), *_STATE.fields])
_Reply = Row(*OUTPUT.names)
#: All that is kept of a request: when to wake, whether its reply was written, and its runs.
_KEPT = T.StructType(
    [T.StructField("wake", _LONG), T.StructField("written", _BOOLEAN), T.StructField("runs", T.ArrayType(_STATE))]
)
#: What a run remembers of each of its chunks: time, whether there is one, whether a token, length of the text shown.
_CHUNK = np.dtype([("at", "<i8"), ("timed", "?"), ("token", "?"), ("size", "<i4")])
_FIRST_LINE = re.compile(r"[^\n-\r\x1c-\x1e\x85\u2028\u2029]*")


def _flat(piece: Piece) -> tuple:
    return (*piece[:8], *piece.words, *piece.lead, *piece.line, piece.chars)


def _piece(row) -> Piece:
    values = tuple(row)
    n = 8 + len(WORDS)
    return Piece(*values[:8], values[8:n], values[n : n + 3], values[n + 3 : n + 6], values[n + 6])


@functools.cache
def _between(word: str) -> re.Pattern:
    return re.compile(rf"(?is)(?=(.){word}(.))")


def _in_word(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


def _stated(word: str, seam: str) -> bool:
    return any(not _in_word(m[1]) and not _in_word(m[2]) for m in _between(word).finditer(seam))


def _extend(line: tuple[str, bool, bool], piece: tuple[str, bool, bool]) -> tuple[str, bool, bool]:
    text, more, open_ = line
    if not open_:
        return line
    joined = text + piece[0]
    limit = K.LABEL_FALLBACK_CHARS
    return joined[:limit], more or piece[1] or bool(joined[limit:].strip()), piece[2]


def _least(a: int | None, b: int | None, pick) -> int | None:
    known = [x for x in (a, b) if x is not None]
    return pick(known) if known else None


def merged(a: Piece, b: Piece) -> Piece:
    """Two runs, ``a`` before ``b``; what follows a completion is not read."""
    if a.done:
        return a._replace(high=b.high)
    seam = a.tail + b.head
    edge = fragments.EDGE
    return Piece(
        a.low,
        b.high,
        _least(a.end_us, b.end_us, max),
        a.token_us if a.token_us is not None else b.token_us,
        b.done,
        a.chunks + b.chunks,
        (a.head + b.head)[:edge],
        (a.tail + b.tail)[-edge:],
        tuple(x or y or _stated(w, seam) for w, x, y in zip(WORDS, a.words, b.words)),
        _extend(a.lead, b.lead),
        b.line if a.line[0] == "" else _extend(a.line, b.lead),
        a.chars + b.chars,
    )


def _line(text: str) -> tuple[str, bool, bool]:
    line, limit = _FIRST_LINE.match(text)[0], K.LABEL_FALLBACK_CHARS
    return line[:limit], bool(line[limit:].strip()), len(line) == len(text)


def summary(text: str) -> tuple:
    """``head`` to ``chars`` of a text, as :func:`callscope.functions.fragments.summarize`."""
    edge = fragments.EDGE
    words = tuple(_stated(w, text) for w in WORDS)
    return text[:edge], text[-edge:], words, _line(text), _line(text.lstrip()), len(text)


def cut(run: Piece, text: str, chunks: bytes, low: int, high: int) -> Piece:
    """The chunks ``low`` to ``high`` of a run."""
    each = np.frombuffer(chunks, _CHUNK)
    ends = np.r_[0, np.cumsum(each["size"])]
    first, last = low - run.low, high - run.low + 1
    own = each[first:last]
    times, tokens = own["at"][own["timed"]], own["at"][own["timed"] & own["token"]]
    return Piece(
        low,
        high,
        int(times.max()) if len(times) else None,
        int(tokens[0]) if len(tokens) else None,
        run.done and high == run.high,
        last - first,
        *summary(text[ends[first] : ends[last]]),
    )


def add(pieces: list[Piece], run: Piece, part: Callable[[int, int], Piece] | None = None) -> None:
    """Put a run into its place among the runs, which stay apart and in order.

    ``part`` gives some chunks of it, for a run that is known in part.
    """
    new, low = [], run.low
    for known in pieces[max(bisect_right([p.low for p in pieces], low) - 1, 0) :]:
        if known.low > run.high:
            break
        if known.low > low:
            new.append((low, known.low - 1))
        low = max(low, known.high + 1)
    if low <= run.high:
        new.append((low, run.high))
    for low, high in new:
        whole = (low, high) == (run.low, run.high)
        _insert(pieces, run if whole else part(low, high))


def _insert(pieces: list[Piece], chunk: Piece) -> None:
    at = bisect_right([p.low for p in pieces], chunk.low)
    pieces.insert(at, chunk)
    if at + 1 < len(pieces) and chunk.high + 1 == pieces[at + 1].low:
        pieces[at : at + 2] = [merged(chunk, pieces[at + 1])]
    if at and pieces[at - 1].high + 1 == chunk.low:
        pieces[at - 1 : at + 1] = [merged(pieces[at - 1], pieces[at])]


class ReplyState(StatefulProcessor):
    """Keeps the runs of a request; writes its reply once."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, as every look at a state is a message to the JVM and back.
        self.kept = handle.getValueState("kept", _KEPT)

    def _wake(self, now: int | None, last_us: int) -> int:
        """One timer, ``idle`` after the last chunk."""
        at = last_us // 1000 + self.idle_ms
        if now is not None and at <= now:
            return now
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = len(_STATE) + 1
        came = sorted(((_piece(row[1:n]), row[n], row[n + 1]) for row in rows), key=lambda c: c[0].low)
        now, written, held = self.kept.get() or (None, False, [])
        wake = self._wake(now, max((run.end_us or 0 for run, _, _ in came), default=0))
        if written:
            if wake != now:
                self.kept.update((wake, True, []))
            return
        runs = [_piece(r) for r in held]
        for run, text, chunks in came:
            add(runs, run, functools.partial(cut, run, text, chunks))
        written = bool(runs) and runs[0].low == 1 and runs[0].done
        if written:
            yield _Reply(key[0], True, *_flat(runs[0]))
        self.kept.update((wake, written, [] if written else [_flat(r) for r in runs]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        runs = [_piece(r) for r in (self.kept.get() or (None, True, []))[2]]
        if runs:
            yield _Reply(key[0], False, *_flat(functools.reduce(merged, runs)))
        self.kept.clear()

    def close(self) -> None:
        pass


_RUNS = (
    "request_id bigint, low bigint, high bigint, end_us bigint, token_us bigint, done boolean, chunks bigint,"
    " text string, parts binary"
)


def _join_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a batch as runs of neighbouring ones; of one number the earliest counts. A run ends at a completion."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column("seq").null_count:
            raise ValueError("a chunk has no number")
        order = pc.sort_indices(
            batch, sort_keys=[(c, "ascending") for c in ("request_id", "seq", "at", "event_type", "delta")], null_placement="at_start"
        )
        batch = batch.take(order)
        for last in (False, True):
            request, none = (np.asarray(x) for x in (pc.fill_null(batch.column("request_id"), 0), batch.column("request_id").is_null()))
            seq = np.asarray(batch.column("seq"))
            same = (request[1:] == request[:-1]) & (none[1:] == none[:-1])
            if not last:
                batch = batch.filter(pa.array(np.r_[True, ~same | (seq[1:] != seq[:-1])]))
        done, token = np.asarray(batch.column("done")), np.asarray(batch.column("token"))
        timed, at = np.asarray(batch.column("at").is_valid()), np.asarray(pc.fill_null(batch.column("at"), 0))
        starts = np.flatnonzero(np.r_[True, ~same | (seq[1:] != seq[:-1] + 1) | done[:-1]])
        ends = np.r_[starts[1:], len(seq)]
        offsets = np.r_[starts, len(seq)].astype(np.int32)
        n = np.arange(len(seq))
        latest = np.maximum.reduceat(np.where(timed, at, np.iinfo(np.int64).min), starts)
        first = np.minimum.reduceat(np.where(timed & token, n, len(seq)), starts)
        each = np.empty(len(seq), _CHUNK)
        each["at"], each["timed"], each["token"] = at, timed, token
        each["size"] = np.asarray(pc.utf8_length(batch.column("text")))
        places = (offsets * _CHUNK.itemsize).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("request_id").take(pa.array(starts)),
                pa.array(seq[starts]),
                pa.array(seq[ends - 1]),
                pa.array(latest, mask=~np.logical_or.reduceat(timed, starts)),
                pa.array(at[np.minimum(first, len(seq) - 1)], mask=first == len(seq)),
                pa.array(done[ends - 1]),
                pa.array(ends - starts, pa.int64()),
                pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), batch.column("text")), ""),
                pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(each.tobytes())]),
            ],
            names=["request_id", "low", "high", "end_us", "token_us", "done", "chunks", "text", "parts"],
        )


def _runs(chunks: DataFrame, typed: bool, delay: str) -> DataFrame:
    """Runs of neighbouring chunks; ``seq`` is a chunk's number. A run is as late as its last chunk."""
    is_text = F.col("event_type") == K.TEXT_EVENT
    text = F.coalesce("delta", F.lit(""))
    counts = F.coalesce(is_text, F.lit(False)) if typed else text != ""
    done = F.coalesce(F.col("event_type") == K.DONE_EVENT, F.lit(False)) if typed else F.lit(False)
    rows = chunks.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.unix_micros("ts").alias("at"),
        "event_type",
        "delta",
        counts.alias("token"),
        done.alias("done"),
        (F.when(counts, text).otherwise(F.lit("")) if typed else text).alias("text"),
    )
    runs = rows.mapInArrow(_join_neighbours, _RUNS).withColumn("ts", F.timestamp_micros("end_us"))
    return runs.withWatermark("ts", delay).withColumn("_s", fragments.summarize(F.col("text"))).select(
        *["request_id", "low", "high", "end_us", "token_us", "done", "chunks"],
        "_s.head",
        "_s.tail",
        *[F.col(f"_s.{w}").alias(w) for w in WORDS],
        *[F.col(f"_s.{of}.{part}").alias(f"{of}_{part}") for of in ("lead", "line") for part in LINE],
        F.col("_s.chars").alias("chars"),
        "text",
        "parts",
        "ts",
    )


def reply_stream(chunks: DataFrame, idle: str, delay: str, typed: bool = False) -> DataFrame:
    """Replies of a live chunk log (``request_id, seq, ts, event_type, delta``), each written once.

    ``whole`` says that nothing can change the reply any more. Chunks that come more than
    ``delay`` behind the newest are dropped. The stream needs a state store of RocksDB, see
    :func:`callscope.streaming.live.run_once`.
    """
    spark = chunks.sparkSession
    idle_ms = spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {idle})")).first()[0]
    rows = _runs(chunks, typed, delay)
    return rows.groupBy("request_id").transformWithState(ReplyState(idle_ms), OUTPUT, "Append", "EventTime")


def reply_view(
    written: DataFrame, chunks: DataFrame, requests: DataFrame, typed: bool = False, **sizes: int
) -> DataFrame:
    """Time to first token of all requests: replies as written, the others from the log.

    Replies written whole are taken as they are, without a look at their chunks. One
    written after a pause is, too, if the log has no more chunks of it.
    """
    final = written.where("whole")
    open_ = chunks.join(final.select("request_id"), "request_id", "left_anti")
    once = (
        written.where("NOT whole")
        .groupBy("request_id")
        .agg(F.count("*").alias("_times"), F.sum("chunks").alias("_held"), F.bool_or("done").alias("_done"))
    )
    counted = open_.groupBy("request_id").agg(F.count_distinct("seq").alias("_have"))
    # A completion that came with gaps before it may leave chunks behind it unread.
    same = once.join(counted, "request_id").where("_times = 1 AND _held = _have AND NOT _done")
    kept = final.unionByName(written.join(same.select("request_id"), "request_id", "left_semi"))
    rest = open_.join(same.select("request_id"), "request_id", "left_anti")
    line = lambda of: F.struct(*[F.col(f"{of}_{part}").alias(part) for part in LINE])
    text = F.struct(
        "head", "tail", *WORDS, line("lead").alias("lead"), line("line").alias("line"), F.col("chars").alias("chars")
    )
    pieces = kept.select(
        "request_id",
        F.timestamp_micros("end_us").alias("end_at"),
        F.timestamp_micros("token_us").alias("token_at"),
        "chunks",
        "done",
        text.alias("text"),
    )
    return ttft.timed(pieces.unionByName(ttft.reduce_chunks(rest, typed, **sizes)), requests)
