"""What the vector searches share: usable rows, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_EVERY = 100


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def is_query(id: str = "vec_id") -> Column:
    return F.col(id) % QUERY_EVERY == 0


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    rows = len(lists)
    return np.asarray(lists.flatten()).reshape(rows, -1) if rows else np.zeros((0, 0))


def best_per_query(found: DataFrame, k: int, score: Column) -> DataFrame:
    """``query_id, rank, vec_id, score``: the first ``k`` of each query by ``score``, then id."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(score, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
