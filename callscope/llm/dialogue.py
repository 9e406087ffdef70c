"""Repair of damaged conversations: the cheapest edits, by a Viterbi search in parallel chunks.

A conversation's rows must get the role initials ``(s?(ua)+)?``. Keep costs 0, Rerole to user or
assistant 3, Delete 4, Insert of an empty user or assistant row 3, and a truncated row that stays 3 more;
blank and repeated rows must be deleted. Of the cheapest edits those are taken whose initials in
order come first in ASCII.

Method: the search has four states (nothing yet, after system, user, assistant). Rows are sorted and
dealt by ranges of conversation and turn, so that a long conversation lies in several
tasks, and cut into chunks of ``CHUNK`` rows. A chunk's costs to the end, row by row backwards,
depend on the costs at its own end, which are those of the chunk behind; every chunk starts from a
speculative vector instead. Then fix-up passes: a chunk whose vector from behind
differs by more than a constant from the one it used runs again, and stops at the row
where both vectors differ by a constant only, from where on its old results hold. Passes end when no
chunk is stale; each is a written table. A chunk's edits depend on differences of costs alone, so
the stitched vectors drive the tracing: from the state a chunk is entered in, the
ASCII-least letter on a cheapest way. The states in which chunks are entered follow from each
chunk's table of four exits. As vectors less their smallest cost are few, a step of
rows is a look-up in a small table.

Defined results: a null ``conv_id`` is a conversation of its own; null roles and texts, and null ids in the
hash, stand as one blank. Rows are ordered by turn, null first, rows of one turn by role and then a
hash of the text; equal rows are interchangeable. A role is known by its first letter; others must be reroled
or deleted. A conversation without rows left has zeros, an empty audit and no repaired rows. Other
columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscope.llm.common import keep

CHUNK = 16_384

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row, and the role it has.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: (state, initial) to the state after a kept row; initials count like the states they lead to.
KEPT = {
    (START, SYSTEM): SYSTEM,
    (START, USER): USER,
    (SYSTEM, USER): USER,
    (USER, ASSISTANT): ASSISTANT,
    (ASSISTANT, USER): USER,
}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

#: A row's code: its initial (0 for any other), whether it is truncated, whether it must go.
CUT, FORCED = 4, 8
BLANK, DUPLICATE = "blank", "duplicate"

NEVER = 1 << 40
BLANKS = " \t\n\u000b\f\r"

Vector = tuple[int, int, int, int]


def _closed(costs: list[int]) -> Vector:
    """With rows inserted where that is cheaper."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return (min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant)


def _relative(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(c - least for c in costs)


#: Costs behind the last row, and the guess for a chunk that has others behind it.
END = _closed([0, NEVER, NEVER, 0])
GUESS = (0, 0, 0, 0)


def _options(after: Vector, code: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost to the end and next state of each edit of a row, in order of the letters."""
    found = [("D", DELETE + after[state], state)]
    if code < FORCED:
        extra = TRUNCATED if code & CUT else 0
        to = KEPT.get((state, code & 3))
        if to is not None:
            found.append(("K", KEEP + extra + after[to], to))
        found.append(("R", REROLE + extra + after[NEXT[state]], NEXT[state]))
    return found


@functools.lru_cache(maxsize=1 << 16)
def before(after: Vector, code: int) -> Vector:
    """Costs in front of a row from those behind it, less a constant."""
    return _relative(_closed([min(cost for _, cost, _ in _options(after, code, s)) for s in range(4)]))


@functools.lru_cache(maxsize=1 << 16)
def edits(after: Vector, code: int, state: int) -> tuple[str, int]:
    """The letters up to and with a row's own, and the state behind it."""
    here = _closed([min(cost for _, cost, _ in _options(after, code, s)) for s in range(4)])
    letters = ""
    while True:
        for letter, cost, to in _options(after, code, state):
            # "I" lies between "D" and the others.
            if letter != "D" and INSERT + here[NEXT[state]] == here[state]:
                break
            if cost == here[state]:
                return letters + letter, to
        letters, state = letters + "I", NEXT[state]


def closing(state: int) -> str:
    """Inserts behind the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def back(codes: bytes, tail: Vector) -> Vector:
    """Costs in front of a chunk."""
    for code in reversed(codes):
        tail = before(tail, code)
    return tail


def fixed(codes: bytes, old_tail: Vector, old_head: Vector, tail: Vector) -> Vector:
    """The same once the costs behind are known, run only as far as they make a difference."""
    for code in reversed(codes):
        if tail == old_tail:
            return old_head
        tail, old_tail = before(tail, code), before(old_tail, code)
    return tail


def vectors(codes: bytes, tail: Vector) -> list[Vector]:
    """Costs behind every row of a chunk."""
    out = [tail]
    for code in reversed(codes[1:]):
        out.append(before(out[-1], code))
    return out[::-1]


def exits(codes: bytes, tail: Vector) -> list[int]:
    """The state behind a chunk for each state in front of it."""
    states = list(range(4))
    for after, code in zip(vectors(codes, tail), codes):
        states = [edits(after, code, s)[1] for s in states]
    return states


def trace(codes: bytes, tail: Vector, state: int, last: bool) -> tuple[list[str], list[int], str]:
    """Per row the letters and the state in front; and the closing letters."""
    letters, states = [], []
    for after, code in zip(vectors(codes, tail), codes):
        states.append(state)
        found, state = edits(after, code, state)
        letters.append(found)
    return letters, states, closing(state) if last else ""


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the rows after damage; nulls of the last two as a blank."""
    one = F.lit(" ")
    number = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    fault = (F.crc32(number.cast("binary")) % 20).cast("int")
    text, role = F.coalesce("text", one), F.coalesce("role", one)
    return conversations.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _signs(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, body, row, blank, cut``: what the search needs of each row."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.sha2(F.col("text").cast("binary"), 256).alias("body"),
        "row",
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def _repeated(signs: DataFrame) -> DataFrame:
    """The signs with ``repeated``: the role and text occur in an earlier row.

    An aggregate finds the first of each text that occurs more than once, so a text that fills a
    conversation is one row of a join, whose other side may be split.
    """
    place = F.struct("turn", "row")
    often = signs.groupBy("conv_id", "role", "body").agg(F.count("*").alias("often"), F.min(place).alias("first"))
    often = keep(often.where("often > 1"), "repeated").select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("body").alias("_body"), "first"
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("body") == F.col("_body"))
    )
    later = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return signs.join(often, same, "left").withColumn("repeated", later).drop("_conv", "_role", "_body", "first")


CHUNKS = (
    "conv_id bigint, part int, chunk int, rows array<bigint>, codes binary, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, "
    "first_initial int, last_initial int, head array<bigint>, end_head array<bigint>"
)


def _chunks(size: int):
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    schema = pa.schema(
        [
            (n, {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k])
            for n, k in (f.split() for f in CHUNKS.split(", "))
        ]
    )

    def chunk(part: int, number: int, rows: list[dict]) -> dict:
        initials = [r["initial"] for r in rows]
        turns = [r["turn"] for r in rows]
        known = [t for t in turns if t is not None]
        codes = bytes(
            r["initial"] | (FORCED if r["blank"] or r["repeated"] else CUT if r["cut"] else 0) for r in rows
        )
        return {
            "conv_id": rows[0]["conv_id"],
            "part": part,
            "chunk": number,
            "rows": [r["row"] for r in rows],
            "codes": codes,
            "blank": sum(r["blank"] for r in rows),
            "duplicate": sum(r["repeated"] and not r["blank"] for r in rows),
            "truncated": sum(c & CUT > 0 for c in codes),
            "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])),
            "turns": len(set(known)),
            "low": known[0] if known else None,
            "high": known[-1] if known else None,
            "first_turn": turns[0],
            "last_turn": turns[-1],
            "first_initial": initials[0],
            "last_initial": initials[-1],
            "head": list(back(codes, GUESS)),
            "end_head": list(back(codes, _relative(END))),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        done: list[dict] = []
        part, number = 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= size):
                    done.append(chunk(part, number, held))
                    held, number = [], number + 1
                part = row["part"]
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if held:
            yield pa.RecordBatch.from_pylist([chunk(part, number, held)], schema)

    assert schema.names == names
    return run


def chunks_of(signs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows in order, as chunks of one conversation each; ``part`` and ``chunk`` number them along the order."""
    initial = F.left("role", F.lit(1))
    known = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    order = ["conv_id", "turn", "role", "body", "row"]
    ranged = signs.select(*order, "blank", "cut", "repeated", known.alias("initial")).repartitionByRange(*order)
    sorted_ = ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("role", "body")
    return sorted_.mapInArrow(_chunks(size), CHUNKS)


def _per_chunk(frame: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``part, chunk`` and what ``work`` gives for some columns of each row."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                results = [work(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns))]
                made = {n: pa.array(r) for n, r in zip(names, zip(*results))}
                ids = {c: batch.column(c) for c in ("part", "chunk")}
                yield pa.RecordBatch.from_pydict({**ids, **made})

    return frame.select("part", "chunk", *columns).mapInArrow(run, f"part int, chunk int, {schema}")


def _array(vector: Vector):
    return F.array(*[F.lit(v).cast("bigint") for v in vector])


def _stitched(chunks: DataFrame) -> DataFrame:
    """``part, chunk, tail, entry, last`` of every chunk of conversations that have several."""
    along = Window.partitionBy("conv_id").orderBy("part", "chunk")
    light = chunks.select("conv_id", "part", "chunk", "head", "end_head")
    beside = (
        light.withColumn("last", F.lead("part").over(along).isNull())
        .withColumn("only", F.col("last") & F.lag("part").over(along).isNull())
        .where("NOT only")
    )
    end = _array(_relative(END))
    state = keep(
        beside.select(
            "conv_id",
            "part",
            "chunk",
            "last",
            F.when(F.col("last"), end).otherwise(_array(GUESS)).alias("tail"),
            F.when(F.col("last"), F.col("end_head")).otherwise(F.col("head")).alias("head"),
        ),
        "vectors",
    )
    codes = chunks.select("part", "chunk", "codes")
    # A pass may reach one chunk further to the front than the pass before, so they end.
    while True:
        wanted = state.withColumn("wanted", F.when(F.col("last"), end).otherwise(F.lead("head").over(along)))
        stale = keep(wanted.where("wanted != tail"), "stale")
        if stale.isEmpty():
            break
        again = _per_chunk(
            stale.join(codes, ["part", "chunk"]),
            ["codes", "tail", "head", "wanted"],
            lambda c, t, h, w: (list(w), list(fixed(c, tuple(t), tuple(h), tuple(w)))),
            "new_tail array<bigint>, new_head array<bigint>",
        )
        state = keep(
            state.join(again, ["part", "chunk"], "left").select(
                "conv_id",
                "part",
                "chunk",
                "last",
                F.coalesce("new_tail", "tail").alias("tail"),
                F.coalesce("new_head", "head").alias("head"),
            ),
            "vectors",
        )
    tables = _per_chunk(
        state.join(codes, ["part", "chunk"]), ["codes", "tail"], lambda c, t: (exits(c, tuple(t)),), "exits array<bigint>"
    )
    ways = state.join(tables, ["part", "chunk"]).select("conv_id", "part", "chunk", "tail", "last", "exits")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, begins = START, True
        for batch in batches:
            entries = []
            for last, to in zip(batch.column("last").to_pylist(), batch.column("exits").to_pylist()):
                entries.append(START if begins else entry)
                entry, begins = to[entries[-1]], last
            kept = batch.select(["part", "chunk", "tail", "last"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(entries, pa.int32())], names=[*kept.schema.names, "entry"])

    sorted_ = ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return sorted_.mapInArrow(enter, "part int, chunk int, tail array<bigint>, last boolean, entry int")


def _traced(codes: bytes, tail: list[int], entry: int, last: bool) -> tuple:
    letters, states, end = trace(codes, tuple(tail), entry, last)
    rows, kinds, roles, cost = [], [], [], 0
    for n, (found, state, code) in enumerate(zip(letters, states, codes)):
        for letter in found:
            rows.append(None if letter == "I" else n)
            kinds.append(letter)
            roles.append(ROLES[NEXT[state]] if letter in "IR" else None)
            cost += {"I": INSERT, "D": DELETE, "K": KEEP, "R": REROLE}[letter]
            cost += TRUNCATED if letter in "KR" and code & CUT else 0
            state = NEXT[state] if letter == "I" else state
    state = USER if end == "I" else START  # "II" follows a system row
    for n in range(len(end)):
        rows.append(None)
        kinds.append("I")
        roles.append("assistant" if n == len(end) - 1 else "user")
        cost += INSERT
    return "".join(kinds), cost, rows, roles


def repair(conversations: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """A report per conversation, and the repaired rows.

    ``conversations`` has ``conv_id, turn, role, text`` as they are to be repaired. The report has
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; the rows ``conv_id, part, chunk, place``
    (their order), ``edit, role, text``.
    """
    given = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    rows = keep(given.withColumn("row", F.monotonically_increasing_id()), "rows")
    chunks = keep(chunks_of(_repeated(_signs(rows)), size), "chunks")
    several = _stitched(chunks)
    traced = _per_chunk(
        chunks.join(several, ["part", "chunk"], "left").select(
            "part",
            "chunk",
            "codes",
            F.coalesce("tail", _array(_relative(END))).alias("tail"),
            F.coalesce("entry", F.lit(START)).alias("entry"),
            F.coalesce("last", F.lit(True)).alias("last"),
        ),
        ["codes", "tail", "entry", "last"],
        _traced,
        "audit string, cost bigint, at array<bigint>, roles array<string>",
    )
    traced = keep(traced, "edits")

    along = Window.partitionBy("conv_id").orderBy("part", "chunk")
    seam = F.lag("last_initial").over(along)
    legal = F.array(*[F.lit(4 * a + b) for a, b in sorted(LEGAL)])
    beside = chunks.select(
        "*",
        (seam.isNotNull() & ~F.array_contains(legal, 4 * seam + F.col("first_initial"))).cast("bigint").alias("seams"),
        F.coalesce((F.lag("last_turn").over(along) == F.col("first_turn")).cast("bigint"), F.lit(0)).alias("shared"),
    ).drop("rows", "codes", "head", "end_head")
    letters = F.sort_array(F.collect_list(F.struct("part", "chunk", "audit")))
    summed = beside.join(traced.select("part", "chunk", "audit", "cost"), ["part", "chunk"]).groupBy("conv_id").agg(
        F.coalesce(
            F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum("shared")), F.lit(0).cast("bigint")
        ).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum("seams")).alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(letters, lambda x: x["audit"]), "").alias("audit"),
    )
    each = chunks.select("conv_id", "part", "chunk", "rows").join(traced.drop("cost"), ["part", "chunk"]).select(
        "conv_id",
        "part",
        "chunk",
        "rows",
        "audit",
        F.posexplode(F.arrays_zip("at", "roles")).alias("place", "edit"),
    )
    kept = each.select(
        "conv_id",
        "part",
        "chunk",
        "place",
        F.substring("audit", F.col("place") + 1, F.lit(1)).alias("edit"),
        F.element_at("rows", (F.col("edit.at") + 1).cast("int")).alias("row"),
        F.col("edit.roles").alias("new_role"),
    ).where("edit != 'D'")
    texts = rows.select("row", F.col("role").alias("old_role"), "text")
    repaired = kept.join(texts, "row", "left").select(
        "conv_id",
        "part",
        "chunk",
        "place",
        "edit",
        F.coalesce("new_role", "old_role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return summed, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text`` joined by newlines, of conversations with rows.

    The hash is one sequence by nature: a conversation's rows stream through one task, which
    holds one batch of them at a time.
    """
    ranked = repaired.select("conv_id", "part", "chunk", "place", "role", "text")
    sorted_ = ranked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([c for c, _ in done], pa.int64()), "repaired_sha256": [h for _, h in done]}
            )

        for batch in batches:
            done: list = []
            for of, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if running is not None and of != conv:
                    done.append((conv, running.hexdigest()))
                    running = None
                if running is None:
                    conv, running = of, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if done:
                yield row()
        if running is not None:
            done = [(conv, running.hexdigest())]
            yield row()

    return sorted_.mapInArrow(run, "conv_id bigint, repaired_sha256 string")
