"""Replies from a stream of chunks, one state per request, against the batch operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callscope.functions import constants as K
from callscope.functions import fragments
from callscope.operators import ttft
from callscope.streaming import arrivals, live


def _equal(got, want):
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.count() == want.count() > 0


def _log(spark, path, files):
    for rows in files:
        frame = spark.createDataFrame(rows, "request_id bigint, seq bigint, at double, event_type string, delta string")
        chunk = frame.select("request_id", "seq", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")).alias("ts"), "event_type", "delta")
        chunk.coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _requests(spark, ids):
    return spark.createDataFrame([(i, 0) for i in ids], "request_id bigint, at bigint").select(
        "request_id", F.timestamp_seconds("at").alias("sent_at")
    )


PARTS = ["", " bl", "ock", " al", "low ", "re", "view", "\n", "  ", "word", "Block", "é", "x" * 12, None, "."]


def _random_replies(seed):
    """Chunks of forty requests in five files: split, out of order, sent twice, some without an end."""
    chance = random.Random(seed)
    files = [[] for _ in range(5)]
    for request in range(40):
        n = chance.randrange(1, 12)
        for seq in range(1, n + 1):
            done = seq == n - (request % 5 == 0) and request % 3 != 0
            kind = K.DONE_EVENT if done else chance.choice([K.TEXT_EVENT, K.TEXT_EVENT, "other"])
            file = min(4, seq * 5 // (n + 1))
            row = (request, seq, file * 60 + seq + request / 100, kind, chance.choice(PARTS))
            if request % 7 == 1 and seq == 2 and n > 3:
                file += file < 4  # behind its successor
            files[file].append(row)
            if request % 4 == 1:
                files[min(4, file + chance.randrange(2))].append(row)
    for rows in files:
        chance.shuffle(rows)
    return files


@pytest.mark.parametrize("typed", [True, False])
def test_equals_batch(spark, tmp_path, typed):
    log = _log(spark, str(tmp_path / "chunks"), _random_replies(3))
    requests = _requests(spark, [*range(40), 99])
    stream = live.read_log(spark, str(tmp_path / "chunks"), 1)
    written = live.run_once(arrivals.reply_stream(stream, "2 MINUTES", "10 MINUTES", typed), "replies", live.ROCKSDB)
    whole = written.where("whole")
    assert (whole.count() > 5) == typed
    assert written.count() == written.select("request_id").distinct().count()
    want = ttft.ttft_from_chunks(log, requests, typed)
    _equal(arrivals.reply_view(written, log, requests, typed), want)
    # What is written whole needs nothing of the log.
    if typed:
        ids = whole.select("request_id")
        alone = arrivals.reply_view(written, log.join(ids, "request_id", "left_anti"), requests, typed)
        _equal(alone, want)


def test_repeated_chunks_count_once(spark, tmp_path):
    """Repeats come in the same file, in the next one, and after the completion."""
    one, two = (1, 1, 1.0, K.TEXT_EVENT, "bl"), (1, 2, 2.0, K.TEXT_EVENT, "ock")
    end, behind = (1, 3, 3.0, K.DONE_EVENT, None), (1, 4, 4.0, K.TEXT_EVENT, "allow")
    log = _log(spark, str(tmp_path / "chunks"), [[one, one], [one, two], [two, end], [end, one, behind]])
    requests = _requests(spark, [1])
    stream = live.read_log(spark, str(tmp_path / "chunks"), 1)
    written = live.run_once(arrivals.reply_stream(stream, "1 HOUR", "1 HOUR", True), "replies", live.ROCKSDB)
    row = written.first()
    assert written.count() == 1 and (row.whole, row.chunks, row.chars) == (True, 3, 5)
    seen = arrivals.reply_view(written, log, requests, True).first()
    assert (seen.chunks, seen.label, seen.ttft_us) == (3, "BLOCK", 1_000_000)
    _equal(arrivals.reply_view(written, log, requests, True), ttft.ttft_from_chunks(log, requests, True))
    assert ttft.ttft_from_chunks(log, requests).first().chunks == 4


def test_silence_ends_a_reply(spark, tmp_path):
    """Without a completion event a reply is written once it has been silent, and a
    chunk after that is in the view all the same."""
    path = str(tmp_path / "chunks")
    files = [[(1, 1, 10.0, "x", "allow")], [(2, 1, 4000.0, "x", "a")], [(2, 2, 9000.0, "x", "b")], [(2, 3, 9100.0, "x", "b")], [(1, 2, 9500.0, "x", "ed")], [(3, 1, 9600.0, "x", "c")]]
    log = _log(spark, path, files)
    written = live.run_once(
        arrivals.reply_stream(live.read_log(spark, path, 1), "1 HOUR", "10 MINUTES"), "replies", live.ROCKSDB
    )
    assert {r.request_id for r in written.collect()} >= {1} and written.where("whole").isEmpty()
    requests = _requests(spark, [1, 2, 3])
    _equal(arrivals.reply_view(written, log, requests), ttft.ttft_from_chunks(log, requests))


def test_state_of_a_request_has_a_fixed_size():
    """However many chunks a reply has, in order they are one run."""

    def chunk(seq, text):
        return arrivals.Piece(seq, seq, seq, seq, False, 1, text[: fragments.EDGE], text[-fragments.EDGE :],
                              (False,) * 3, (text[:30], False, True), (text[:30], False, True), len(text))

    runs: list = []
    for seq in range(1, 5000):
        arrivals.add(runs, chunk(seq, "word "))
    assert len(runs) == 1 and runs[0].chunks == 4999
    assert len(runs[0].head) + len(runs[0].tail) + len(runs[0].lead[0]) + len(runs[0].line[0]) < 100
    runs = []
    order = list(range(1, 200))
    random.Random(1).shuffle(order)
    for seq in order:
        arrivals.add(runs, chunk(seq, f"{seq} "))
    assert len(runs) == 1 and runs[0].line[0] == "".join(f"{n} " for n in range(1, 200))[:30]


TEXTS = ["", " ", "block", "a block.", "  \n x", "unblock", "\u2028 Allow \x85b", "é block_ REVIEW!", "w " * 40, "x" * 31 + "\n", "\x1c\n review", "BLOCK\tallow "]


def test_summary_of_a_text(spark):
    """Texts are summarised in Python as by the built-in functions."""
    chance = random.Random(5)
    texts = TEXTS + ["".join(chance.choice(TEXTS + ["."]) for _ in range(4)) for _ in range(60)]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n bigint, t string")
    rows = frame.select("n", fragments.summarize(F.col("t")).alias("s")).orderBy("n").collect()
    for text, row in zip(texts, rows):
        s = row.s
        want = (s.head, s.tail, tuple(s[w] for w in arrivals.WORDS), tuple(s.lead), tuple(s.line), s.chars)
        assert arrivals.summary(text) == want, repr(text)


def test_neighbouring_chunks_reach_the_state_as_one_run(spark, tmp_path):
    """A log of many chunks a request asks the state once per request and batch, not per chunk."""
    rows = [(r, n, float(n), K.TEXT_EVENT, f"{n} ") for r in range(3) for n in range(1, 400)]
    log = _log(spark, str(tmp_path / "chunks"), [rows])
    runs = arrivals._runs(log, True, "1 HOUR")
    assert runs.count() <= 6 and runs.agg(F.sum("chunks")).first()[0] == len(rows)


@pytest.mark.parametrize("typed", [True, False])
def test_runs_known_in_part(spark, tmp_path, typed):
    """Runs that overlap: what is known counts once, the rest is cut out of them."""
    chance = random.Random(11)
    files = []
    for _ in range(5):
        rows = []
        for request in range(12):
            low = chance.randrange(1, 20)
            for seq in range(low, low + chance.randrange(1, 12)):
                kind = K.DONE_EVENT if seq == 26 and request % 2 else K.TEXT_EVENT
                delta = PARTS[(seq * 7 + request) % len(PARTS)]
                rows.append((request, seq, float(seq), kind, delta))
        files.append(rows)
    files.append([(r, n, float(n), K.TEXT_EVENT, PARTS[(n * 7 + r) % len(PARTS)]) for r in range(12) for n in range(1, 26)])
    files.append([(r, 26, 26.0, K.DONE_EVENT if r % 2 else K.TEXT_EVENT, PARTS[(26 * 7 + r) % len(PARTS)]) for r in range(12)])
    path = str(tmp_path / "chunks")
    log = _log(spark, path, files)
    stream = arrivals.reply_stream(live.read_log(spark, path, 1), "1 HOUR", "1 HOUR", typed)
    written = live.run_once(stream, "replies", live.ROCKSDB)
    assert written.where("whole").count() == (6 if typed else 0)
    requests = _requests(spark, range(12))
    want = ttft.ttft_from_chunks(log, requests, typed)
    _equal(arrivals.reply_view(written, log, requests, typed), want)
    if typed:  # what the state holds, without a look at the log
        ids = written.select("request_id")
        alone = arrivals.reply_view(written, log.limit(0), requests.join(ids, "request_id", "left_semi"), typed)
        _equal(alone, want.join(ids, "request_id", "left_semi").select(*alone.columns))
