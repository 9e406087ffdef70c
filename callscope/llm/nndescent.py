"""Approximate nearest neighbours over a graph built by NN-descent.

Building. Equal vectors are one node. Every node starts with the nearest of some blocks:
nodes whose ``CELLS`` nearest landmarks include the same one, about ``BLOCK`` at a time. Then
rounds of joins: each node's list and some of the nodes that list it are joined with
their vectors, the members of such a group are compared with one another, and a pair goes
on only if it is better than the worst neighbour that one of the two has. Lists keep
``DEGREE`` neighbours. Rounds end when few places change. Groups do not grow with the data.

Searching. The graph's links are the lists and, from each node, up to ``LINKS`` of the nodes that
list it, first those that the fewest lists hold. A link of that kind can be taken both ways,
so the nodes that such links connect reach one another; one node of each such component
is an entry, and so is every node without one. A query starts at the landmarks and the
entries nearest to it, and at its own node if its vector is indexed. In every hop the nearest
``WIDTH`` nodes of its beam that have not been expanded are joined with the graph, and
their neighbours are merged into the beam of the ``BEAM`` nearest; a query ends when its beam is
expanded. All queries take their hops together. At the end distances are computed in
double precision on the original vectors, and nodes become the ids of their rows: the
``k + 1`` smallest of each node, which is all that k results can hold.

Landmarks and entries grow with the nodes. Up to ``LANDMARKS`` of them travel with the
tasks; of more, that many do, and the others are joined by the nearest of those. Every row is
indexed. The graph's vectors are in single precision, unscaled, and
all distances in double precision, so vectors of any lengths stand beside one another.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do those of another length than most (of two lengths
equally common, the smaller counts); a query's own id is left out; equal
distances rank by the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscope.llm.common import bounded, forget, keep, released
from callscope.llm.components import components
from callscope.llm.vectors import best_per_query, matrix

#: Landmarks are one for so many nodes; up to so many travel with the tasks.
SPREAD, LANDMARKS = 1024, 4096
#: Cells of a node, and nodes compared at once in a cell.
CELLS, BLOCK = 4, 2048
DEGREE = 24
#: Nodes that have a node in their list, of which so many join its group.
REVERSE = 12
#: Links of the search from a node to nodes that list it.
LINKS = 24
ENTRIES = 8
BEAM = 384
WIDTH = 32
#: Rows whose distances are held at once, and pairs in a batch of results.
STRIP, FOUND = 256, 50_000
#: Building stops once a round changes fewer than this share of all list places, but not
#: before so many rounds: how good the start was differs with the data.
CHANGED, LEAST_ROUNDS = 0.05, 2
#: More rounds and hops than any graph has needed; they only stop an endless run.
ROUNDS = 12
HOPS = 40


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def _rows(column) -> np.ndarray:
    """Packed vectors as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_pylist()
    if not values:
        return np.zeros((0, 0), np.float32)
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def _pairs(nodes: np.ndarray, others: np.ndarray, distance: np.ndarray) -> dict:
    return {
        "node": pa.array(nodes, pa.int64()),
        "other": pa.array(others, pa.int64()),
        "distance": pa.array(distance, pa.float64()),
    }


PAIRS = "node bigint, other bigint, distance double"


class Marks:
    """Finds the nearest of some nodes (``node, packed``) for rows of any number."""

    def __init__(self, marks: DataFrame):
        marks = keep(marks, "marks")
        count = marks.count()
        sample = marks.orderBy(F.xxhash64("node"), "node").limit(LANDMARKS).collect()
        self.ids = np.array([r["node"] for r in sample], np.int64)
        self.top = _rows(pa.array([bytes(r["packed"]) for r in sample], pa.binary()))
        self.table = None
        if count > len(sample):
            placed = keep(self._at_top(marks, "node", 1), "placed")
            sizes = placed.groupBy("mark").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
            dealt = placed.join(bounded(keep(sizes, "sizes")), "mark")
            pieces = dealt.groupBy("mark", F.pmod(F.xxhash64("node"), "shares").alias("share")).agg(
                F.collect_list(F.struct("node", "packed")).alias("l")
            )
            self.table = keep(
                pieces.select("mark", F.col("l.node").alias("others"), F.col("l.packed").alias("vectors")), "by_mark"
            )

    def _at_top(self, rows: DataFrame, key: str, count: int) -> DataFrame:
        ids, top = self.ids, self.top

        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, STRIP):
                    part = batch.slice(start, STRIP)
                    apart = _distances(_rows(part.column("packed")), top)
                    best = np.argsort(apart, axis=1, kind="stable")[:, :count]
                    each = pa.array(np.repeat(np.arange(part.num_rows), best.shape[1]))
                    yield pa.RecordBatch.from_pydict(
                        {
                            key: part.column(key).take(each),
                            "packed": part.column("packed").take(each),
                            "mark": pa.array(ids[best.ravel()], pa.int64()),
                            "distance": pa.array(np.take_along_axis(apart, best, 1).ravel(), pa.float64()),
                        }
                    )

        return rows.select(key, "packed").mapInArrow(
            released(run), f"{key} bigint, packed binary, mark bigint, distance double"
        )

    def nearest(self, rows: DataFrame, key: str, count: int) -> DataFrame:
        """``key, packed, mark, distance``: the ``count`` nearest of each of ``rows`` (``key, packed``)."""
        if self.table is None:
            return self._at_top(rows, key, count)

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    others = np.asarray(batch.column("others")[row].values)
                    near = _rows(batch.column("vectors")[row].values)
                    apart = _distances(_rows(batch.column("packed").slice(row, 1)), near)[0]
                    best = np.argsort(apart, kind="stable")[:count]
                    each = pa.array(np.full(len(best), row))
                    yield pa.RecordBatch.from_pydict(
                        {
                            key: batch.column(key).take(each),
                            "packed": batch.column("packed").take(each),
                            "mark": pa.array(others[best], pa.int64()),
                            "distance": pa.array(apart[best], pa.float64()),
                        }
                    )

        cells = self._at_top(rows, key, CELLS).drop("distance").join(self.table, "mark").drop("mark")
        found = cells.mapInArrow(released(run), f"{key} bigint, packed binary, mark bigint, distance double")
        order = Window.partitionBy(key).orderBy("distance", "mark")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n")


class Graph:
    """The tables of an index: members of each node, vectors, links, landmarks and entries."""

    def __init__(self, members: DataFrame, nodes: DataFrame, links: DataFrame, landmarks: Marks, entries: Marks, width: int):
        self.members, self.nodes, self.links, self.width = members, nodes, links, width
        self.landmarks, self.entries = landmarks, entries


def _plain(vector: str) -> Column:
    """Negative zeros become zeros, so that equal vectors are equal arrays."""
    return F.transform(vector, lambda x: x + F.lit(0.0).cast("float"))


def _members(vectors: DataFrame, k: int) -> DataFrame:
    """``node, vector, ids``: the k + 1 smallest ids of every distinct vector."""
    rows = vectors.select("vec_id", _plain("vector").alias("vector"))
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return first.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _width(vectors: DataFrame) -> int | None:
    """The most common number of components."""
    sizes = vectors.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("rows"))
    first = sizes.where("width > 0").orderBy(F.desc("rows"), "width").first()
    return first and first["width"]


def _packed(vectors: DataFrame, key: str = "node", vector: str = "vector") -> DataFrame:
    """``key, packed``: the vectors in single precision."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(1)).astype(np.float32)
                yield pa.RecordBatch.from_pydict(
                    {key: batch.column(0), "packed": pa.array([r.tobytes() for r in rows], pa.binary())}
                )

    return vectors.select(key, vector).mapInArrow(released(run), f"{key} bigint, packed binary")


def _start(nodes: DataFrame, landmarks: Marks) -> DataFrame:
    """First neighbours: the nearest in each block of the cells of the nearest landmarks."""
    placed = keep(landmarks.nearest(nodes, "node", CELLS).withColumnRenamed("mark", "cell").drop("distance"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    blocks = placed.join(bounded(keep(sizes, "sizes")), "cell").withColumn("share", F.pmod(F.xxhash64("node"), "shares"))

    def nearest(block: pa.Table) -> pa.Table:
        ids, rows = np.asarray(block["node"]), _rows(block["packed"])
        count = min(DEGREE, len(ids) - 1)
        if count < 1:
            return pa.table(_pairs(ids[:0], ids[:0], np.zeros(0)))
        others, distance = [], []
        for start in range(0, len(ids), STRIP):
            apart = _distances(rows[start : start + STRIP], rows)
            own = np.arange(len(apart))
            apart[own, start + own] = np.inf
            best = np.argpartition(apart, count - 1, axis=1)[:, :count]
            others.append(ids[best.ravel()])
            distance.append(np.take_along_axis(apart, best, 1).ravel())
        return pa.table(_pairs(np.repeat(ids, count), np.concatenate(others), np.concatenate(distance)))

    return blocks.select("node", "packed", "cell", "share").groupBy("cell", "share").applyInArrow(nearest, PAIRS)


def _lists(pairs: DataFrame) -> DataFrame:
    """The ``DEGREE`` nearest of each node, distinct, with whether the pair is new."""
    once = pairs.groupBy("node", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy("distance", "other")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= DEGREE).drop("n")


def _reverse(edges: DataFrame) -> DataFrame:
    """``node, other``: up to ``LINKS`` nodes that list a node, first those in the fewest lists."""
    listed = edges.groupBy(F.col("other").alias("node")).agg(F.count("*").alias("listed"))
    order = Window.partitionBy("other").orderBy("listed", "distance", "node")
    by = edges.join(listed, "node", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    first = by.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LINKS)
    return first.select(F.col("other").alias("node"), F.col("node").alias("other"))


def _entries(nodes: DataFrame, reverse: DataFrame) -> DataFrame:
    """One node of each component of the links that can be taken both ways, and nodes without any."""
    found = keep(components(reverse.select(F.col("node").alias("a"), F.col("other").alias("b"))), "components")
    inner = found.where("node != root").select("node")
    return nodes.join(inner, "node", "left_anti")


def _compare(batches):
    """Pairs among each node's neighbours that are better than the worst one's place."""
    for batch in batches:
        found, held = [], 0
        for row in range(batch.num_rows):
            others = np.asarray(batch.column("others")[row].values)
            worst = np.asarray(batch.column("worst")[row].values)
            fresh = np.asarray(batch.column("fresh")[row].values)
            vectors = np.frombuffer(b"".join(batch.column("vectors")[row].as_py()), np.float32)
            rows = vectors.reshape(len(others), -1)
            apart = _distances(rows, rows)
            # A pair of old neighbours has been compared before.
            better = (apart < worst[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(better, False)
            a, b = np.nonzero(better)
            found.append((others[a], others[b], apart[a, b]))
            held += len(a)
            if held >= FOUND:
                yield pa.RecordBatch.from_pydict(_pairs(*(np.concatenate(x) for x in zip(*found))))
                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_pydict(_pairs(*(np.concatenate(x) for x in zip(*found))))


def build(vectors: DataFrame, k: int = 10) -> Graph | None:
    """The index of ``vectors`` (``vec_id, vector``)."""
    width = _width(vectors)
    if width is None:
        return None
    members = keep(_members(vectors.where(F.size("vector") == width), k), "members")
    count = members.count()
    nodes = keep(_packed(members), "nodes")
    wanted = -(-count // SPREAD)
    few = nodes.orderBy(F.xxhash64("node"), "node").limit(wanted)
    landmarks = Marks(few if wanted <= LANDMARKS else nodes.where(F.pmod(F.xxhash64("node"), F.lit(SPREAD)) == 0))
    edges = keep(_lists(_start(nodes, landmarks).withColumn("fresh", F.lit(True))), "edges")
    for done in range(1, ROUNDS + 1):
        worst = edges.groupBy("node").agg(
            F.when(F.count("*") >= DEGREE, F.max("distance")).otherwise(float("inf")).alias("worst")
        )
        known = nodes.join(worst, "node").select(F.col("node").alias("other"), "packed", "worst")
        # A group is a node's list, the nearest nodes that list it, and the node itself.
        nearest = Window.partitionBy("other").orderBy("distance", "node")
        listing = edges.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= REVERSE)
        back = listing.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
        own = nodes.select("node", F.col("node").alias("other"), F.lit(False).alias("fresh"))
        group = edges.select("node", "other", "fresh").union(back).union(own)
        group = group.groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
        active = group.where("fresh").select("node").distinct()
        reached = group.join(active, "node", "left_semi").join(known, "other")
        gathered = reached.groupBy("node").agg(F.collect_list(F.struct("other", "worst", "fresh", "packed")).alias("l"))
        listed = gathered.select(
            F.col("l.other").alias("others"), F.col("l.worst").alias("worst"),
            F.col("l.fresh").alias("fresh"), F.col("l.packed").alias("vectors"),
        )
        found = listed.mapInArrow(released(_compare), PAIRS).groupBy("node", "other").agg(F.min("distance").alias("distance"))
        old = edges.withColumn("fresh", F.lit(False))
        merged = keep(_lists(old.unionByName(found.withColumn("fresh", F.lit(True)))), "edges")
        changed = merged.where("fresh").count()
        forget(edges)
        edges = merged
        if done >= LEAST_ROUNDS and changed < CHANGED * DEGREE * count:
            break
    reverse = keep(_reverse(edges), "reverse")
    links = keep(edges.select("node", "other").union(reverse).distinct(), "links")
    return Graph(members, nodes, links, landmarks, Marks(_entries(nodes, reverse)), width)


def search(graph: Graph, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (``query_id, query``)."""
    vectors = graph.nodes.select(F.col("node").alias("other"), "packed")
    adjacent = keep(
        graph.links.join(vectors, "other")
        .groupBy("node")
        .agg(F.collect_list(F.struct("other", "packed")).alias("l"))
        .select("node", F.col("l.other").alias("others"), F.col("l.packed").alias("vectors")),
        "adjacent",
    )

    def expand(batches):
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                others = np.asarray(batch.column("others")[row].values)
                vectors = np.frombuffer(b"".join(batch.column("vectors")[row].as_py()), np.float32)
                query = np.asarray(batch.column("query")[row].values)
                apart = _distances(query[None, :], vectors.reshape(len(others), -1))[0]
                found.append((np.full(len(others), batch.column("query_id")[row].as_py()), others, apart))
            if found:
                q, node, distance = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_pydict(
                    {"query_id": pa.array(q), "node": pa.array(node), "distance": pa.array(distance, pa.float64())}
                )

    reached = "query_id bigint, node bigint, distance double"
    asked = keep(queries.where(F.size("query") == graph.width).select("query_id", "query"), "asked")
    packed = _packed(asked, "query_id", "query")
    # A node that is an entry for itself alone is found if it is among the k + 1 nearest entries.
    entered = [
        marks.nearest(packed, "query_id", count).select("query_id", F.col("mark").alias("node"), "distance")
        for marks, count in ((graph.landmarks, ENTRIES), (graph.entries, max(ENTRIES, k + 1)))
    ]
    own = asked.select("query_id", _plain("query").alias("vector")).join(graph.members, "vector")
    entered.append(own.select("query_id", "node", F.lit(0.0).alias("distance")))
    first = functools.reduce(DataFrame.unionByName, entered).groupBy("query_id", "node").agg(F.min("distance").alias("distance"))
    beam = keep(first.withColumn("expanded", F.lit(False)), "beam")
    for _ in range(HOPS):
        nearest = Window.partitionBy("query_id").orderBy("distance", "node")
        step = beam.where("NOT expanded").withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= WIDTH)
        step = keep(step.select("query_id", "node"), "step")
        if step.isEmpty():
            break
        seen = adjacent.join(bounded(step), "node").join(asked, "query_id")
        found = seen.select("query_id", "query", "others", "vectors").mapInArrow(released(expand), reached)
        done = step.withColumn("expanded_now", F.lit(True))
        old = beam.join(done, ["query_id", "node"], "left").withColumn(
            "expanded", F.col("expanded") | F.coalesce("expanded_now", F.lit(False))
        ).drop("expanded_now")
        both = old.unionByName(found.withColumn("expanded", F.lit(False)))
        once = both.groupBy("query_id", "node").agg(F.min("distance").alias("distance"), F.max("expanded").alias("expanded"))
        ranked = once.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= BEAM).drop("n")
        after = keep(ranked, "beam")
        forget(beam)
        forget(step)
        beam = after
    squares = F.aggregate(
        F.zip_with("query", "vector", lambda a, b: a.cast("double") - b.cast("double")),
        F.lit(0.0),
        lambda total, d: total + d * d,
    )
    exact = (
        beam.select("query_id", "node")
        .join(graph.members, "node")
        .join(asked, "query_id")
        .select("query_id", F.explode("ids").alias("vec_id"), F.sqrt(squares).alias("score"))
        .where(F.col("vec_id") != F.col("query_id"))
    )
    return best_per_query(exact, k, F.col("score").asc())


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Build and search in one go."""
    graph = build(vectors, k)
    if graph is None:
        spark = vectors.sparkSession
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(graph, queries, k)
