"""Joins with a table that has one row per key, safe for hot keys.

In a shuffled join all rows of a key meet in one task. Run-time re-planning splits
such a task only where both sides were just shuffled, so the split is made here:
rows of keys that hold a large share of the table are joined by broadcast, with
only those keys' entries, and the rest by an ordinary join. Which keys are hot
follows from exact counts, so every branch agrees on it even when recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A hot key holds more than one in SHARE rows: at most SHARE entries are broadcast,
# however large either side is.
SHARE = 2_000
FLOOR = 1_000_000


def hot_keys(rows: DataFrame, key: str, share: int = SHARE, floor: int = FLOOR) -> DataFrame:
    """The keys that hold more than ``floor`` rows and more than one in ``share``."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.where((F.col("_n") > floor) & (F.col("_n") * share > total)).select(key)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    *,
    share: int = SHARE,
    floor: int = FLOOR,
) -> DataFrame:
    """Join ``rows`` with ``table``, which has each ``key`` once.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Without hot
    keys, their branch is dropped at run time before it reads anything.
    """
    hot = F.broadcast(hot_keys(rows, key, share, floor))
    keyed = rows.where(F.col(key).isNotNull())
    ordinary = keyed.join(hot, key, "left_anti").join(table, key, how)
    few = F.broadcast(table.join(hot, key, "left_semi"))
    joined = ordinary.unionByName(keyed.join(hot, key, "left_semi").join(few, key, how))
    if how in ("left", "left_anti"):
        # Rows without a key match nothing; they need no shuffle to find that out.
        without = rows.where(F.col(key).isNull())
        joined = joined.unionByName(without, allowMissingColumns=True)
    return joined
