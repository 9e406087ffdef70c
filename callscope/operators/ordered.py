"""Ordinal, previous value and running sum per key, safe for hot keys.

A plain window puts all rows of a key into one task. Here a key that holds a
large share of the table is cut into slices along its whole order (time and tie-break as
one number, so rows of one instant are cut too); each slice is one window partition, and
what it needs from earlier slices (a count, a last value, a sum) comes from a small carry
table. Other keys keep a single slice. Slices that are still too full, as beside a
stray early row, are cut again within their own bounds, level after level. Every figure
the cut depends on is a count, minimum or maximum, so a recomputed task cuts the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"

# A key is hot when it holds more than one in SHARE rows, so at most SHARE keys
# are hot and at most SLICES_PER_SHARE * SHARE * 2 slices exist per level,
# whatever the table size: that bounds the two broadcasts below.
SHARE = 20_000
SLICES_PER_SHARE = 8
# Keys with fewer rows than this are never cut.
FLOOR = 1_000_000
# How often an overfull slice is cut again; each level zooms in on the rows it holds.
LEVELS = 3


@dataclass(frozen=True)
class Sliced:
    """A table with slice numbers, and its rows of hot keys alone; none without hot keys."""

    rows: DataFrame
    hot: DataFrame | None

    def map(self, step: Callable[[DataFrame], DataFrame]) -> Sliced:
        return Sliced(step(self.rows), None if self.hot is None else step(self.hot))


def _position(df: DataFrame, order: Sequence[str]) -> Column:
    """The place in the order as a number that grows along it; NULL first, as in a sort.

    An order of another shape than a time and an id is cut along its first column only.
    """
    key = order_key(df, order)
    if isinstance(df.select(key.alias("k")).schema["k"].dataType, T.DecimalType):
        return key
    if isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order[0]).cast("timestamp")).cast("double")
    return F.col(order[0]).cast("double")


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """What extremum aggregates compare rows by: never NULL as a whole, ties included.

    A time and an id become one number of fixed length (NULL first, as in a sort): an
    aggregate that compares by a structure cannot be hashed and would sort its rows.
    """
    if len(order) == 1:
        return F.col(order[0])
    kinds = [df.schema[c].dataType for c in order]
    timed = isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType))
    if len(order) != 2 or not timed or not isinstance(kinds[1], T.IntegralType):
        return F.struct(*order)
    whole = T.DecimalType(38, 0)
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    time = F.coalesce(at, F.lit(-(10**18))).cast("decimal(19,0)")
    place = F.coalesce(F.col(order[1]).cast("decimal(19,0)") + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0)))
    return ((time * F.lit(Decimal(2**33)) * F.lit(Decimal(2**32))).cast(whole) + place).cast(whole)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[c].eqNullSafe(right[f"_k{i}"]) for i, c in enumerate(columns)]
    )


def _lookup(
    df: DataFrame, small: DataFrame, columns: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join with a side whose size the constants above bound, NULL keys included."""
    keyed = small.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)],
        *[c for c in small.columns if c not in columns],
    )
    return df.join(F.broadcast(keyed), _same(df, keyed, columns), how).drop(
        *[f"_k{i}" for i in range(len(columns))]
    )


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.select(*keys, _position(df, order).alias("_at")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi")
    )


def _hot_keys(
    ranges: DataFrame, keys: Sequence[str], total: Column, share: int, floor: int
) -> DataFrame | None:
    """The hot keys, fewer than ``share`` by their definition, as a table of the driver.

    Found once and eagerly: all branches of a plan then cut alike, and without hot keys the
    plan is that of a plain window.
    """
    slices = F.ceil(F.col("_n") * share / total) * SLICES_PER_SHARE
    hot = ranges.where((F.col("_n") > floor) & (F.col("_n") * share > total)).select(
        *keys, "_lo", "_hi", slices.cast("double").alias("_slices")
    )
    found = hot.collect()
    return hot.sparkSession.createDataFrame(found, hot.schema) if found else None


def _cut(
    df: DataFrame, hot_keys: DataFrame, keys: Sequence[str], order: Sequence[str], how: str
) -> DataFrame:
    """Number the equal-width slices of every hot key; NULL for the other rows."""
    # Differences are exact; only then does a share of the width become a double.
    behind = (_position(df, order) - F.col("_lo")).cast("double")
    along = behind / ((F.col("_hi") - F.col("_lo")).cast("double") + 1)
    number = F.floor(F.coalesce(along, F.lit(-1.0)) * F.col("_slices")).cast("bigint")
    return (
        _lookup(df, hot_keys, keys, how)
        .withColumn("_cut", F.when(F.col("_slices").isNotNull(), number))
        .drop("_lo", "_hi", "_slices")
    )


def slice_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    share: int = SHARE,
    floor: int = FLOOR,
    levels: int = LEVELS,
) -> Sliced:
    """Add ``_slice``: NULL for an ordinary key, else a number that grows along ``order``.

    Slices of a level have equal width, several times as many as an even spread
    needs; each further level takes one more pass over the rows of hot keys.
    """
    keys = list(keys)
    ranges = _ranges(df, keys, order)
    total = ranges.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    hot_keys = _hot_keys(ranges, keys, total, share, floor)
    if hot_keys is None:
        return Sliced(df.withColumn(SLICE, F.lit(None).cast("bigint")), None)
    total = F.lit(df.count())
    sliced = Sliced(
        *[
            _cut(df, hot_keys, keys, order, how).withColumnRenamed("_cut", SLICE)
            for how in ("left", "inner")
        ]
    )
    for _ in range(levels - 1):
        finer_keys = [*keys, SLICE]
        finer = _hot_keys(_ranges(sliced.hot, finer_keys, order), finer_keys, total, share, floor)
        if finer is None:
            break
        room = 1 << 20  # more than the slices one level can make
        number = F.col(SLICE) * room + room // 2 + F.coalesce(F.col("_cut"), F.lit(0))
        sliced = sliced.map(
            lambda part, keys=finer_keys, hot=finer: _cut(part, hot, keys, order, "left")
            .withColumn(SLICE, number)
            .drop("_cut")
        )
    return sliced


def _local(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _carry(
    hot: DataFrame | None, keys: Sequence[str], aggregate: Column, carried: Column
) -> DataFrame | None:
    """One row per slice of a hot key, with what the slices before it hand over."""
    if hot is None:
        return None
    return hot.groupBy(*keys, SLICE).agg(aggregate.alias("_carry")).withColumn("_carry", carried)


def _add(out: DataFrame, name: str) -> DataFrame:
    return out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")


def sliced_running_sum(
    sliced: Sliced, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> Sliced:
    """Sum of ``value`` from the key's first row up to this one."""
    keys = list(keys)
    held = sliced.map(lambda part: part.withColumn("_value", value))
    carry = _carry(held.hot, keys, F.sum("_value"), F.sum("_carry").over(_before(keys)))
    within = F.sum("_value").over(
        _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def step(part: DataFrame) -> DataFrame:
        out = part.withColumn(name, within).drop("_value")
        return out if carry is None else _add(_lookup(out, carry, [*keys, SLICE]), name)

    return held.map(step)


def sliced_ordinal(sliced: Sliced, keys: Sequence[str], order: Sequence[str], name: str) -> Sliced:
    """Position of the row within its key, from 1."""
    keys = list(keys)
    carry = _carry(sliced.hot, keys, F.count(F.lit(1)), F.sum("_carry").over(_before(keys)))
    within = F.row_number().over(_local(keys, order)).cast("bigint")

    def step(part: DataFrame) -> DataFrame:
        out = part.withColumn(name, within)
        return out if carry is None else _add(_lookup(out, carry, [*keys, SLICE]), name)

    return sliced.map(step)


def sliced_previous(
    sliced: Sliced, keys: Sequence[str], order: Sequence[str], column: str, name: str
) -> Sliced:
    """``column`` of the key's row before this one, NULL on its first row."""
    keys = list(keys)
    held = sliced.rows if sliced.hot is None else sliced.hot
    last = F.max_by(column, order_key(held, order) if len(order) > 1 else F.struct(*order))
    along = Window.partitionBy(*keys).orderBy(SLICE)
    carry = _carry(sliced.hot, keys, last, F.lag("_carry").over(along))
    window = _local(keys, order)

    def step(part: DataFrame) -> DataFrame:
        if carry is None:
            return part.withColumn(name, F.lag(column).over(window))
        local = part.withColumn("_first", F.row_number().over(window) == 1).withColumn(
            name, F.lag(column).over(window)
        )
        out = _lookup(local, carry, [*keys, SLICE])
        before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name))
        return out.withColumn(name, before).drop("_first", "_carry")

    return sliced.map(step)


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, **cut: int
) -> DataFrame:
    """Add ``name``, the position of each row within its key along ``order``."""
    sliced = slice_hot_keys(df, keys, order, **cut)
    return sliced_ordinal(sliced, keys, order, name).rows.drop(SLICE)


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, **cut: int
) -> DataFrame:
    """Add ``name``, the value ``column`` had on the key's row before."""
    sliced = slice_hot_keys(df, keys, order, **cut)
    return sliced_previous(sliced, keys, order, column, name).rows.drop(SLICE)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, **cut: int
) -> DataFrame:
    """Add ``name``, the sum of ``value`` over the key's rows up to this one."""
    sliced = slice_hot_keys(df, keys, order, **cut)
    return sliced_running_sum(sliced, keys, order, value, name).rows.drop(SLICE)


def known_along(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    last: dict[str, Column],
    backwards: bool = False,
) -> DataFrame:
    """Add running sums up to each row, and the last value that is not NULL up to it.

    For rows that lie in slices of bounded size as they are: ``slices`` number them along a key, ``order`` is
    that within one. Each slice is a window partition; what the slices before it hand over comes from one
    row per slice. ``backwards`` reads every key from its end.
    """
    keys, slices = list(keys), list(slices)
    turned = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    along = [F.col(c).desc() if backwards else F.col(c).asc() for c in slices]
    inside = Window.partitionBy(*keys, *slices).orderBy(*turned)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = df.withColumns({f"_{n}": v for n, v in {**sums, **last}.items()}).withColumns(
        {n: F.sum(f"_{n}").over(upto) for n in sums} | {n: F.last(f"_{n}", True).over(upto) for n in last}
    )
    # The last row of a slice has what the slice knows.
    ends = held.groupBy(*keys, *slices).agg(
        *[F.sum(f"_{n}").alias(f"_{n}") for n in sums],
        *[
            (F.min_by if backwards else F.max_by)(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))).alias(f"_{n}")
            for n in last
        ],
    )
    before = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys,
        *slices,
        *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums],
        *[F.last(f"_{n}", True).over(before).alias(f"_{n}") for n in last],
    )
    names = [*sums, *last]
    carry = carry.select(*[F.col(c).alias(f"_at_{c}") for c in [*keys, *slices]], *[F.col(f"_{n}").alias(f"_before_{n}") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*keys, *slices]])
    joined = held.join(carry, same, "left")
    return joined.withColumns(
        {n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums}
        | {n: F.coalesce(n, f"_before_{n}") for n in last}
    ).drop(*[f"_{n}" for n in names], *[f"_before_{n}" for n in names], *[f"_at_{c}" for c in [*keys, *slices]])
