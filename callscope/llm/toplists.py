"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Method: every component has a list of the candidates sorted by it. A query reads the lists
from the end where its products are largest, deeper round by round. What
has been read gives a candidate a lower bound (unread products at their list's
smallest) and an upper bound (unread products where their list's reading stands). Candidates
whose upper bound stays below the k-th largest lower bound are outsiders and leave; once
few are left, their final scores are resolved. Nothing is approximate: if
the bounds never part, the lists are read to their end.

Candidates are dealt into blocks of about ``BLOCK`` rows and queries into blocks of
``QUERIES``; a task holds one of each, sorts the lists once and reads them for ``TILE`` queries together:
with every unread component of a candidate replaced by its bound, the bounds of all pairs are one
product of matrices. A first pass over one block gives each query the k-th best score there;
all other blocks start from that as threshold, and one whose lists' first entries together stay below
it is not read for that query. A query's first k of every block are ranked
together, each task's own first k being cut before the shuffle. Work grows with queries times
candidates read; memory per task does not grow.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows without an id; vectors of different lengths are not compared; a query's own
id is left out, repeated rows of another id are candidates of their own; equal scores rank by the
smaller id. Components beyond 2^63 / 1024 saturate, and so do scores beyond 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import keep
from callscope.llm.vectors import best_per_query, matrix

BLOCK = 4096
QUERIES = 8192
#: Queries that read the lists together.
TILE = 512
#: Share of a list that has been read at the end of each round.
ROUNDS = (0.06, 0.25, 0.5, 1.0)
#: Reading stops once so many times k candidates can still qualify.
FEW = 8

#: Below any score of 64-bit numbers.
NONE = -(1 << 200)


class SortedLists:
    """One block of candidates, with a sorted list per component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, order, axis=0)
        self.place = np.empty_like(order)  # of each candidate in each list
        np.put_along_axis(self.place, order, np.arange(len(rows))[:, None], axis=0)

    def _bounds(self, left: np.ndarray, depth: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        """Components of the candidates for the lower and the upper bounds: as they are where the
        lists have been read, from the large end (first half) or from the small end."""
        n, rows, place = len(self.rows), self.rows[left], self.place[left]
        top, bottom = place >= n - depth, place < depth
        at = min(depth, n - 1)
        lower = np.hstack([np.where(top, rows, self.sorted[0]), np.where(bottom, rows, self.sorted[-1])])
        upper = np.hstack(
            [np.where(top, rows, self.sorted[n - 1 - at]), np.where(bottom, rows, self.sorted[at])]
        )
        return lower.astype(dtype), upper.astype(dtype)

    def best(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: list[int | None]
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and scores of the first k that reach its floor, largest score
        first, then smallest id."""
        n = len(self.ids)
        most = int(np.abs(queries.astype(object)).max(initial=0)) * int(np.abs(self.rows.astype(object)).max(initial=0))
        # Doubles are exact up to 2^53; larger numbers are Python's.
        dtype = np.float64 if 2 * most * max(1, queries.shape[1]) < 1 << 53 else object
        signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(dtype)
        floor = np.array([NONE if f is None else f for f in floors], dtype)
        out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        highest = np.hstack([self.sorted[-1], self.sorted[0]]).astype(dtype)
        active = np.flatnonzero((signed @ highest) >= floor)
        left = np.arange(n)
        for share in ROUNDS:
            if not len(active):
                break
            depth = int(np.ceil(share * n))
            lower, upper = self._bounds(left, depth, dtype)
            own = self.ids[left][None, :] == query_ids[active][:, None]
            low = signed[active] @ lower.T
            high = low if depth >= n else signed[active] @ upper.T
            if dtype is object:
                low, high = (np.clip(x, -(1 << 63), (1 << 63) - 1) for x in (low, high))
            low = np.where(own, np.array(NONE, dtype), low)
            if len(left) > k:
                floor[active] = np.maximum(floor[active], np.partition(low, len(left) - k, axis=1)[:, len(left) - k])
            alive = (high >= floor[active][:, None]) & ~own
            few = (alive.sum(axis=1) <= FEW * k) | (depth >= n)
            for q, row in zip(active[few], alive[few]):
                out[q] = self._resolved(left[row], queries[q], k, dtype)
            active, alive = active[~few], alive[~few]
            left = left[alive.any(axis=0)]
        return out

    def _resolved(self, left: np.ndarray, query: np.ndarray, k: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        whole = dtype is not object
        scores = self.rows[left] @ query if whole else self.rows[left].astype(object) @ query.astype(object)
        if not whole:
            scores = np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
        first = np.lexsort((self.ids[left], -scores.astype(np.float64) if whole else ~scores))[:k]
        return self.ids[left][first], scores[first]

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query without a floor."""
        return self.best(np.array([query_id]), query[None, :], k, [None])[0]


FOUND = "asked bigint, query_id bigint, vec_id bigint, score bigint"


def _top(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    if candidates.num_rows and queries.num_rows:
        lists = SortedLists(np.asarray(candidates["vec_id"]), matrix(candidates["vector"]))
        for start in range(0, queries.num_rows, TILE):
            tile = queries.slice(start, TILE)
            ids = np.asarray(tile["query_id"])
            best = lists.best(ids, matrix(tile["query"]), k, tile["floor"].to_pylist())
            found += [(n, i, *b) for n, i, b in zip(tile["n"].to_pylist(), ids.tolist(), best)]
    sizes = [len(f[2]) for f in found]
    none = [np.zeros(0, np.int64)]
    return pa.table(
        {
            "asked": pa.array(np.repeat([f[0] for f in found], sizes).astype(np.int64)),
            "query_id": pa.array(np.repeat([f[1] for f in found], sizes).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([f[2] for f in found] or none)),
            "score": pa.array(np.concatenate([f[3] for f in found] or none)),
        }
    )


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (``query_id, query``) against
    ``vectors`` (``vec_id, vector``), whole numbers both."""
    number = F.monotonically_increasing_id().alias("n")
    given = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = keep(given.select("vec_id", "vector", F.size("vector").alias("width"), number), "vectors")
    asked = queries.where("query_id IS NOT NULL AND query IS NOT NULL")
    asked = keep(asked.select("query_id", "query", F.size("query").alias("width"), number), "queries")
    blocks = max(1, -(-rows.count() // BLOCK))
    shares = max(1, -(-asked.count() // QUERIES))
    # Rows are numbered in sequence, so any way of repetition spreads evenly.
    dealt = rows.withColumn("block", (F.col("n") % blocks).cast("int"))
    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    share = (F.col("n") % shares).cast("int").alias("share")
    key = ["width", "block", "share"]

    def search(first: int, last: int, floors: DataFrame | None) -> DataFrame:
        """Against blocks ``first`` to ``last``."""
        inside = dealt.where(F.col("block").between(first, last))
        held = inside.select("vec_id", "vector", "width", "block", every_share)
        floor = F.lit(None).cast("bigint").alias("floor")
        sent = asked.select("*", floor) if floors is None else asked.join(floors, "n", "left")
        block = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("block")
        sent = sent.select("n", "query_id", "query", "floor", "width", share, block)
        return held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(lambda a, b: _top(a, b, k), FOUND)

    found = keep(search(0, 0, None), "first-block")
    if blocks > 1:
        kth = F.when(F.count("*") >= k, F.min("score")).alias("floor")
        floors = found.groupBy(F.col("asked").alias("n")).agg(kth)
        found = found.unionByName(search(1, blocks - 1, floors))
    return best_per_query(found.drop("asked"), k, F.col("score").desc())
