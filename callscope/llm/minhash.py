"""Near duplicates through an inverted join over signature coordinates.

Method: every text's set of distinct five-word shingles gets a MinHash signature of 64
coordinates. Sets are posted under each coordinate-value pair. A pair of sets counts as
a candidate if at least ``MATCHES`` coordinates collide, so only postings of a value
that two sets share matter, and of those a pair must share one among each set's
rarest ``shared - MATCHES + 1`` (the prefix). Long lists thus end up outside the
prefixes; they are skipped while pairs are found and only probed when a found pair's
collisions are counted. Candidates are confirmed on their full sets.

No list is turned into all its pairs. Sets that are equal are one class. Then every
prefix list first links its members to one leader, the member whose coordinates are
the most common (the original of a group of variants has them); confirmed links are
contracted, and what is in one component needs no more pairs. After that, members outside
the component that most of a list belongs to are compared with the members of the list
in other components. A pair is formed in one of its common
lists only, and only if it can share enough: the shingles are counted in ``PARTS`` parts of
their hash range, leaving out those that no other candidate has, and two sets have at
most the sum of the smaller counts in common. Every candidate pair is
therefore confirmed or refuted on its full sets, ruled out by an exact bound, or lies
within one component already, at every size of list.

Two sets with a Jaccard similarity of 0.75 share 48 of 64 coordinates on average; with
fewer than 30 (probability about 3e-7) a pair would be missed.

Defined results: words are what lies between ASCII blanks, A-Z lower-cased; a text of one
to four words is one shingle; a null text or one without words has an empty set and
is linked with nothing. Rows with a null id take part in links like any other; the
smallest non-null id names a component (null if there is none). Repeated rows are copies.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bounded, keep, with_columns
from callscope.llm.components import components

WORDS = 5
COORDINATES = 64
MATCHES = 30
#: Parts of the shingles' hash range that bound what two sets have in common.
PARTS = 32
#: Similarity as a fraction of integers: 100 * both >= 75 * any.
PER_CENT = 75

#: Distinct words remembered per task.
MEMORY = 400_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed values: its shifts and multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Turns texts into sorted distinct shingle hashes; remembers the words' hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, {}

    def of(self, text: str | None) -> np.ndarray:
        parts = text.encode("utf-8").lower().split() if text else []
        if not parts:
            return np.zeros(0, np.uint64)
        known = self.hashes
        if len(known) > MEMORY:
            known.clear()
        for word in set(parts).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        each = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        width = min(self.words, len(each))
        whole = np.full(len(each) - width + 1, width, np.uint64)
        for k in range(width):
            whole = _mixed(whole ^ each[k : len(each) - width + 1 + k])
        return np.unique(whole)


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
    return seeds[:COORDINATES], seeds[COORDINATES:] | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each permutation, the coordinate in its low bits."""
    flip, factor = _permutations()
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = (shingles[start : start + 1024] ^ flip[:, None]) * factor[:, None]
        least = np.minimum(least, part.min(axis=1))
    low = np.uint64(COORDINATES - 1)
    return (least & ~low) | np.arange(COORDINATES, dtype=np.uint64)


def _set_number(shingles: np.ndarray) -> int | None:
    """A 64-bit number that names a set; none for the empty one."""
    if not len(shingles):
        return None
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the number of shingles, the class (equal for equal sets; two
    different sets share one with probability 2^-64) and the signature of each text."""

    def make():
        shingles = Shingles()

        def work(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles.of(value) for value in texts.to_pylist()]
            rows = [signature(s) for s in sets if len(s)]
            values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
            counts = np.array([len(s) for s in sets], np.int64)
            offsets = np.r_[0, np.cumsum(COORDINATES * (counts > 0))]
            return [
                pa.array(counts),
                pa.array([_set_number(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))),
            ]

        return work

    fields = [("n_shingles", "bigint"), ("class", "bigint"), ("signature", "array<bigint>")]
    return with_columns(docs, text, fields, make, drop=text)


def full_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with class, all shingles of each text (sorted as unsigned
    numbers) and their number in each part of the hash range."""

    def make():
        shingles = Shingles()

        def work(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles.of(value) for value in texts.to_pylist()]
            high = np.uint64(64 - PARTS.bit_length() + 1)
            parts = [np.bincount((s >> high).astype(np.int64), minlength=PARTS) for s in sets]
            return [
                pa.array([_set_number(s) for s in sets], pa.int64()),
                pa.array([p.tolist() for p in parts], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32()),
                    pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)),
                ),
            ]

        return work

    fields = [("class", "bigint"), ("parts", "array<int>"), ("shingles", "array<bigint>")]
    return with_columns(docs, text, fields, make, drop=text)


def _shared(classes: DataFrame) -> DataFrame:
    """``class, n, weight, shared, prefix``: the coordinates each class shares with another
    one (in 32 bits), how common they are, and the rarest of them, which any candidate pair
    must meet in."""
    postings = classes.select("class", "n", F.explode("signature").alias("value"))
    often = postings.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    gathered = postings.join(often, "value").groupBy("class").agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("often", "value"))).alias("found"),
    )
    values = F.col("found.value")
    return gathered.where(F.size("found") >= MATCHES).select(
        "class",
        "n",
        F.aggregate("found.often", F.lit(0).cast("bigint"), lambda total, x: total + x).alias("weight"),
        F.transform(values, lambda v: v.bitwiseXOR(F.shiftright(v, 32)).bitwiseAND(0x7FFFFFFF).cast("int")).alias("shared"),
        F.slice(values, F.lit(1), F.size("found") - MATCHES + 1).alias("prefix"),
    )


def _confirmed(pairs: DataFrame, shared: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with enough collisions and enough common shingles."""
    left = shared.select(F.col("class").alias("a"), F.col("shared").alias("a_shared"))
    right = shared.select(F.col("class").alias("b"), F.col("shared").alias("b_shared"))
    candidates = (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.size(F.array_intersect("a_shared", "b_shared")) >= MATCHES)
        .select("a", "b")
    )
    of_a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("a_set"))
    of_b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("b_set"))
    both = candidates.join(of_a, "a").join(of_b, "b")

    def run(batches):
        for batch in batches:
            a_set, b_set = batch.column("a_set"), batch.column("b_set")
            linked = []
            for x, y in zip(a_set, b_set):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                n = int((y[at] == x).sum())
                linked.append(100 * n >= PER_CENT * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _may_link(n, s, other_n, other_s):
    """Whether two sets can be similar enough: they have at most the smaller number of
    shingles that are not theirs alone in common."""
    both = F.least(s, other_s, n, other_n)
    return (100 * both) >= (PER_CENT * (n + other_n - both))


def _not_alone(sets: DataFrame) -> DataFrame:
    """``class, parts, s``: how many shingles of each set occur in another one, by part
    and in all."""
    each = sets.select("class", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("often"), F.min("class").alias("class"))
    part = F.shiftrightunsigned("shingle", 64 - PARTS.bit_length() + 1).cast("int")
    counts = (
        alone.where("often = 1")
        .groupBy("class", part.alias("part"))
        .agg(F.count("*").cast("int").alias("alone"))
        .groupBy("class")
        .agg(F.map_from_entries(F.collect_list(F.struct("part", "alone"))).alias("alone"))
    )
    none = F.create_map().cast("map<int,int>")
    left = sets.select("class", "parts").join(counts, "class", "left").withColumn(
        "alone", F.coalesce("alone", none)
    )
    rest = F.transform(
        "parts", lambda n, i: n - F.coalesce(F.try_element_at(F.col("alone"), i), F.lit(0))
    )
    return left.select("class", rest.alias("parts")).withColumn(
        "s", F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, x: total + x)
    )


def _may_share(n, parts, other_n, other_parts):
    """The same by parts: what two sets can have in common is the sum of the smaller counts."""
    smaller = F.zip_with(parts, other_parts, lambda a, b: F.least(a, b))
    both = F.aggregate(smaller, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return (100 * both) >= (PER_CENT * (n + other_n - both))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    columns = ("id", "n_shingles", "class", "signature")
    members = keep(sketch(rows, "text").select(*columns), "sketches")
    classes = (
        members.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    )
    shared = keep(_shared(classes), "shared")

    # Full sets of the classes that may have a partner, from one row of each.
    one = (
        members.join(shared.select("class"), "class", "left_semi")
        .groupBy("class")
        .agg(F.min("id").alias("one"))
    )
    one = bounded(keep(one.select("one").distinct(), "one"))
    read = rows.join(one, F.col("id").eqNullSafe(F.col("one")), "left_semi")
    sets = keep(
        full_sets(read, "text")
        .join(shared.select("class"), "class", "left_semi")
        .groupBy("class")
        .agg(F.first("parts").alias("parts"), F.first("shingles").alias("shingles")),
        "sets",
    )

    possible = (
        shared.join(_not_alone(sets), "class")
        .where(_may_link(F.col("n"), F.col("s"), F.col("s"), F.col("s")))
    )
    possible = keep(possible.drop("shared"), "possible")
    lists = possible.select("class", "n", "s", "weight", F.explode("prefix").alias("value"))
    leader = lists.groupBy("value").agg(F.max(F.struct("weight", "class", "n", "s")).alias("l"))
    starred = (
        lists.join(leader, "value")
        .where(
            (F.col("class") != F.col("l.class"))
            & _may_link(F.col("n"), F.col("s"), F.col("l.n"), F.col("l.s"))
        )
        .select(F.least("class", "l.class").alias("a"), F.greatest("class", "l.class").alias("b"))
        .distinct()
    )
    links = keep(_confirmed(starred, shared, sets), "confirmed")
    joined = keep(components(links), "components")

    placed = (
        lists.join(joined.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    # Lists with more than one component; the largest of each needs no pairs within.
    weights = placed.groupBy("value", "root").agg(F.count("*").alias("weight"))
    main = (
        weights.groupBy("value")
        .agg(F.max(F.struct("weight", "root")).alias("main"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("value", F.col("main.root").alias("main"))
    )
    bounds = possible.select("class", "prefix", "parts")
    open_lists = keep(placed.join(main, "value").drop("weight").join(bounds, "class"), "open")
    outside = open_lists.where("root != main").select(
        "value",
        *[F.col(c).alias(x) for c, x in (("class", "x"), ("n", "x_n"), ("s", "x_s"), ("root", "x_root"))],
        F.col("prefix").alias("x_prefix"),
        F.col("parts").alias("x_parts"),
    )
    # Of two members outside the main component one stands on the left, in one list.
    once = (F.col("root") == F.col("main")) | (F.col("x") < F.col("class"))
    here = F.array_min(F.array_intersect("x_prefix", "prefix")) == F.col("value")
    rest = (
        outside.join(open_lists, "value")
        .where(
            (F.col("root") != F.col("x_root"))
            & once
            & _may_link(F.col("n"), F.col("s"), F.col("x_n"), F.col("x_s"))
            & here
            & _may_share(F.col("n"), F.col("parts"), F.col("x_n"), F.col("x_parts"))
        )
        .select(F.least("x", "class").alias("a"), F.greatest("x", "class").alias("b"))
        .distinct()
    )
    more = _confirmed(rest, shared, sets)
    final = keep(components(links.union(more)), "components")

    named = members.join(final.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )
    smallest = named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("smallest"))
    return named.join(smallest, "root", "left").select(
        F.col("id").alias(id),
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"),
    )
