"""Time to first token: from stream chunks to an A/B verdict.

Requests have ``request_id, sent_at``, the moment the call was sent: that is where every
time starts, as waiting and prefill come before the first chunk. Chunks have
``request_id, seq, ts, event_type, delta``; ``seq`` numbers the chunks of a request
from 1. A request's chunks are reduced in levels of ``SPAN`` pieces, so no task ever
holds all chunks of a long request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import constants as K
from callscope.functions import fragments
from callscope.functions import metrics as M
from callscope.operators.ordered import order_key, ordinal

SPAN = 1024
# Levels above the chunks; SPAN ** LEVELS chunks per request meet in one last group
# of SPAN pieces, longer requests only make that last group longer.
LEVELS = 3

ORDER = ("started_at", "call_id")


def _is_done(event_type: Column) -> Column:
    return event_type == K.DONE_EVENT


def group_chunks(chunks: DataFrame, span: int = SPAN, *more_keys: Column) -> DataFrame:
    """Chunks of a request gathered ``span`` at a time; batch or streaming.

    A chunk that was sent again is gathered once.
    """
    piece = F.floor((F.col("seq") - 1) / span).alias("piece")
    row = F.struct("seq", "ts", "event_type", "delta")
    return chunks.groupBy("request_id", piece, *more_keys).agg(F.collect_set(row).alias("rows"))


def _first_token_at(rows: Column, typed: bool) -> Column:
    """Time of the first chunk that counts as a token, rows in sequence order."""
    if typed:
        tokens = F.filter(rows, lambda r: r["event_type"] == K.TEXT_EVENT)
    else:
        tokens = F.filter(rows, lambda r: F.coalesce(r["delta"], F.lit("")) != "")
    return F.try_element_at(tokens, F.lit(1))["ts"]


def _summarize_group(groups: DataFrame, typed: bool) -> DataFrame:
    """One bounded summary per group of chunks."""
    ordered = groups.withColumn("rows", F.sort_array("rows"))
    # One chunk per number; of different ones the earliest.
    new = lambda r, i: (i == 0) | (F.try_element_at("rows", F.greatest(i, F.lit(1)))["seq"] != r["seq"])
    ordered = ordered.withColumn("rows", F.filter("rows", new))
    if typed:
        # The reader stops at the completion event, whatever comes after it.
        done = F.array_min(
            F.transform(
                F.filter("rows", lambda r: _is_done(r["event_type"])), lambda r: r["seq"]
            )
        )
        ordered = ordered.withColumn("done_at", done).withColumn(
            "rows",
            F.filter(
                "rows", lambda r: F.col("done_at").isNull() | (r["seq"] <= F.col("done_at"))
            ),
        )
        text_rows = F.filter("rows", lambda r: r["event_type"] == K.TEXT_EVENT)
    else:
        ordered = ordered.withColumn("done_at", F.lit(None).cast("bigint"))
        text_rows = F.col("rows")
    text = F.array_join(F.transform(text_rows, lambda r: F.coalesce(r["delta"], F.lit(""))), "")
    times = F.transform("rows", lambda r: r["ts"])
    joined = ordered.select(
        "request_id",
        "piece",
        F.array_max(times).alias("end_at"),
        _first_token_at(F.col("rows"), typed).alias("token_at"),
        F.size("rows").cast("bigint").alias("chunks"),
        F.col("done_at").isNotNull().alias("done"),
        text.alias("text"),
    )
    return joined.withColumn("text", fragments.summarize(F.col("text")))


_FIELDS = ("end_at", "token_at", "chunks", "done", "text")


def _merge(a: Column, b: Column) -> Column:
    """Two neighbouring pieces; what follows a completion is not read."""
    both = F.struct(
        F.greatest(a["end_at"], b["end_at"]).alias("end_at"),
        F.coalesce(a["token_at"], b["token_at"]).alias("token_at"),
        (a["chunks"] + b["chunks"]).alias("chunks"),
        b["done"].alias("done"),
        fragments.merge(a["text"], b["text"]).alias("text"),
    )
    return F.when(a["done"], a).otherwise(both)


def _merge_level(pieces: DataFrame, span: int | None) -> DataFrame:
    """Merge neighbouring pieces ``span`` at a time, or all that are left."""
    target = F.lit(0).cast("bigint") if span is None else F.floor(F.col("piece") / span)
    grouped = pieces.groupBy("request_id", target.alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("piece", F.struct(*_FIELDS).alias("s")))).alias("ps")
    )
    folded = F.reduce(
        F.slice("ps", 2, F.greatest(F.size("ps") - 1, F.lit(0))),
        F.element_at("ps", 1)["s"],
        lambda acc, p: _merge(acc, p["s"]),
    )
    return (
        grouped.select("request_id", F.col("up").alias("piece"), folded.alias("s"))
        .select("request_id", "piece", "s.*")
    )


def ttft_from_groups(
    groups: DataFrame,
    requests: DataFrame,
    typed: bool = False,
    span: int = SPAN,
    levels: int = LEVELS,
) -> DataFrame:
    """Timing, label and chunk count per request from grouped chunks.

    Requests join after their chunks are reduced to one row. A request without chunks
    has no token and no times; chunks without a request have no start to count from.
    """
    return timed(reduce_groups(groups, typed, span, levels), requests)


def reduce_groups(
    groups: DataFrame, typed: bool = False, span: int = SPAN, levels: int = LEVELS
) -> DataFrame:
    """Grouped chunks as one row per request: ``end_at, token_at, chunks, done, text``."""
    pieces = _summarize_group(groups, typed)
    for level in range(levels):
        pieces = _merge_level(pieces, None if level == levels - 1 else span)
    return pieces.drop("piece")


def reduce_chunks(
    chunks: DataFrame, typed: bool = False, span: int = SPAN, levels: int = LEVELS
) -> DataFrame:
    """The same from single chunks."""
    return reduce_groups(group_chunks(chunks, span), typed, span, levels)


def timed(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """Times of reduced replies from the sending of their requests on, and their labels."""
    sent = requests.select("request_id", "sent_at")
    joined = sent.join(replies, "request_id", "full")
    start, end = F.unix_micros("sent_at"), F.unix_micros("end_at")
    token = F.unix_micros("token_at")
    return joined.withColumn("text", F.coalesce("text", fragments.empty())).select(
        "request_id",
        F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
        (token - start).alias("ttft_us"),
        (end - start).alias("total_us"),
        F.col("token_at").isNull().alias("no_token"),
        F.col("text.chars").alias("text_chars"),
        fragments.label_of(F.col("text")).alias("label"),
    )


def ttft_from_chunks(
    chunks: DataFrame,
    requests: DataFrame,
    typed: bool = False,
    span: int = SPAN,
    levels: int = LEVELS,
) -> DataFrame:
    """Time to first token, total time and label of every request, from its sending on.

    ``typed`` reads typed events: only text deltas count, the first even if empty,
    and nothing after the completion event. Otherwise the first non-empty delta
    counts.
    """
    return ttft_from_groups(group_chunks(chunks, span), requests, typed, span, levels)


def fill_missing_first_token(ttft: DataFrame) -> DataFrame:
    """Total time where no token came; ``no_token`` keeps the two cases apart."""
    return ttft.withColumn("ttft_us", F.coalesce("ttft_us", "total_us"))


def ttft_tag(ttft: DataFrame, keys: tuple[str, ...] = ("api",), **cut: int) -> DataFrame:
    """Number the calls of each condition; the first warm one is the cache write.

    ``keys`` name what shares a cached prefix. A read has its ``read_speedup`` against
    the mean of the cold calls of its keys, 0 where either time is missing or 0.
    """
    numbered = ordinal(ttft, [*keys, "cond"], ORDER, "run_no", **cut)
    warm = F.col("cond") == K.WARM
    tag = (
        F.when(warm & (F.col("run_no") == 1), F.lit("write"))
        .when(warm, F.concat(F.lit("read "), (F.col("run_no") - 1).cast("string")))
        .otherwise(F.concat(F.lit("run "), F.col("run_no").cast("string")))
    )
    cold = F.col("cond") == K.COLD
    timed = F.count_if(cold & F.col("ttft_ms").isNotNull())
    means = ttft.groupBy(*keys).agg(
        M.mean(F.sum(F.when(cold, F.col("ttft_ms"))), F.nullif(timed, F.lit(0))).alias("_cold")
    )
    named = means.select(*[F.col(k).alias(f"_{k}") for k in keys], "_cold")
    same = [numbered[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    speedup = F.coalesce(M.speedup(F.col("_cold"), F.col("ttft_ms")), F.lit(0.0))
    return (
        numbered.join(named, same)
        .withColumn("tag", tag)
        .withColumn("read_speedup", F.when(warm & (F.col("run_no") > 1), speedup))
        .drop("_cold", *[f"_{k}" for k in keys])
    )


def ttft_ab(
    ttft: DataFrame, keys: tuple[str, ...] = ("api",), session: tuple[str, ...] = ("cache_key",)
) -> DataFrame:
    """Mean cold and warm time to first token, their ratio and the verdict, per ``keys``.

    The first warm call of every session writes that session's cache and is left out of
    the warm mean; ``session`` names the columns that share a cached prefix within
    ``keys``. One aggregation per session, whose few sums are then added up per key.
    """
    cold, warm = F.col("cond") == K.COLD, F.col("cond") == K.WARM
    timed = F.col("ttft_ms").isNotNull()
    own = [c for c in session if c not in keys]
    per_session = ttft.groupBy(*keys, *own).agg(
        F.sum(F.when(cold, F.col("ttft_ms"))).alias("_cold_sum"),
        F.count_if(cold & timed).alias("cold_runs"),
        F.sum(F.when(warm, F.col("ttft_ms"))).alias("_warm_sum"),
        F.count_if(warm & timed).alias("_warm_n"),
        F.min_by("ttft_ms", F.when(warm & timed, order_key(ttft, ORDER))).alias("_write"),
    )
    grouped = per_session.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("_cold_sum", "cold_runs", "_warm_sum", "_warm_n")],
        F.sum("_write").alias("_write"),
        F.count("_write").alias("_writes"),
    )
    write = F.coalesce(F.col("_write"), F.lit(0))
    reads = F.col("_warm_n") - F.col("_writes")
    means = grouped.select(
        *keys,
        "cold_runs",
        reads.alias("warm_reads"),
        M.mean(F.col("_cold_sum"), F.nullif("cold_runs", F.lit(0))).alias("cold_ttft_ms"),
        M.mean(F.col("_warm_sum") - write, F.nullif(reads, F.lit(0))).alias("warm_ttft_ms"),
    )
    return means.withColumn(
        "speedup", M.speedup(F.col("cold_ttft_ms"), F.col("warm_ttft_ms"))
    ).withColumn("verdict", M.verdict(F.col("speedup")))
