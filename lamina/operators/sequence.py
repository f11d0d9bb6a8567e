"""Ordered sequences: a DataFrame and the columns that order it.

``order`` must be a total order.  Positions inside groups are windows over the group.  Positions in a whole table are worked out in two levels,
counts by range of the order and then windows inside a range, so no task sorts the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.names import fresh

Order = list[Column | str]

#: Ranges that a whole table is split into for positions, and how many values find their bounds.
RANGES, SAMPLE = 64, 4096


def _columns(order: Order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def position(order: Order, within: list[str]) -> Column:
    """The position from 1 inside a group; a whole table's positions come from ``with_position``."""
    if not within:
        raise ValueError("a position in a whole table is no window: use with_position")
    return F.row_number().over(Window.partitionBy(*within).orderBy(*_columns(order))).cast("long")


def last(within: list[str]) -> Column:
    """The number of items in the group."""
    if not within:
        raise ValueError("the size of a whole table is its count")
    return F.count(F.lit(1)).over(Window.partitionBy(*within)).cast("long")


def _after(keys: list[Column], bound: tuple) -> Column:
    """Whether the keys, in order, come after a bound; nulls come first."""
    out = F.lit(False)
    for k, b in reversed(list(zip(keys, bound, strict=True))):
        if b is None:
            out = k.isNotNull() | out
        else:
            out = F.coalesce((k > F.lit(b)) | ((k == F.lit(b)) & out), F.lit(False))
    return out


def _range_of(df: DataFrame, order: list[str]) -> Column:
    """The number of each row's range: at most RANGES about even ones, by bounds from a bounded sample of the rows of smallest hashes.

    Bounds are on as many leading order columns as tell the sample's rows apart, so a frequent first value is split by the next column."""
    keys = [F.unix_micros(o) if isinstance(df.schema[o].dataType, T.TimestampType) else F.col(o) for o in order]
    rows = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys))).orderBy(F.xxhash64(*keys), *(f"k{i}" for i in range(len(keys)))).limit(SAMPLE).collect()
    sample = sorted((tuple(r) for r in rows if all(v == v for v in r)), key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
    step = max(1, len(sample) // RANGES)
    for n in range(1, len(order) + 1):
        bounds = sorted({r[:n] for r in sample[step::step]}, key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
        if len(bounds) > RANGES // 2:
            break
    out = F.lit(0)
    for b in bounds if sample else []:
        if n > 1:
            out = out + _after(keys[:n], b).cast("int")
        elif b[0] is not None:
            out = out + (keys[0] > F.lit(b[0])).cast("int")
    # nulls of a lone key compare with nothing
    return out if n > 1 else F.coalesce(out, F.lit(-1))


def with_position(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "pos") -> DataFrame:
    """df with the position of each item from 1.  ``order``: columns, ascending, nulls first; together they tell all rows apart."""
    if within:
        return df.withColumn(name, position(order, within))
    at, before = fresh(df, "_range"), fresh(df, "_before")
    ranged = df.withColumn(at, _range_of(df, order))
    counts = ranged.groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    # at most RANGES + 1 rows
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(at, ahead.alias(before))
    inside = F.row_number().over(Window.partitionBy(at).orderBy(*(F.col(o).asc_nulls_first() for o in order)))
    return ranged.join(F.broadcast(counts), at).withColumn(name, (inside + F.col(before)).cast("long")).drop(at, before)


def subsequence(df: DataFrame, order: list[str], start: float, length: float | None = None, within: list[str] | None = None) -> DataFrame:
    """Items from position start, at most length of them; bounds are rounded as the language does."""
    begin = math.floor(start + 0.5)
    pos = fresh(df, "_pos")
    out = with_position(df, order, within, pos).where(F.col(pos) >= begin)
    if length is not None:
        out = out.where(F.col(pos) < begin + math.floor(length + 0.5))
    return out.drop(pos)


def head(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """The first item; of each group if ``within`` is given, by a partial aggregate instead of a sort."""
    if not within:
        return df.orderBy(*order).limit(1)
    first = df.groupBy(*within).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_item"))
    return first.select("_item.*")


def tail(df: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    return subsequence(df, order, 2, None, within)


def remove(df: DataFrame, order: list[str], at: int, within: list[str] | None = None) -> DataFrame:
    pos = fresh(df, "_pos")
    return with_position(df, order, within, pos).where(F.col(pos) != at).drop(pos)


def insert_before(df: DataFrame, order: list[str], at: int, items: DataFrame) -> DataFrame:
    """df with items before position ``at``; a column ``pos`` gives the new positions.  items: the same columns, few rows in order."""
    n = items.count()
    rows = with_position(df, order, None, "pos")
    moved = rows.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + n).otherwise(F.col("pos")))
    end = rows.count() + 1
    base = min(max(at, 1), end)
    return moved.unionByName(with_position(items, order, None, "pos").withColumn("pos", F.col("pos") + base - 1))


def reverse(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*(F.col(o).desc_nulls_last() for o in order))


def concatenated(*parts: DataFrame) -> DataFrame:
    """The items of all parts, part by part: a column ``_part`` comes first in the order of the whole."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def predicates(df: DataFrame, order: list[str], within: list[str] | None, *tests: Callable[[Column, Column], Column]) -> DataFrame:
    """Chained predicates: each gets position and size in what its predecessors left, and positions are counted anew for each.

    The size is worked out only for tests that read it.  Without ``within`` positions come range by range, the size from a count."""
    pos, size = fresh(df, "_pos"), fresh(df, "_last")
    for test in tests:
        kept = test(F.col(pos), F.col(size))
        sized = size in str(kept)
        if within:
            df = df.withColumn(pos, position(order, within))
            df = df.withColumn(size, last(within)) if sized else df
        else:
            n = df.count() if sized else 0
            df = with_position(df, order, None, pos)
            df = df.withColumn(size, F.lit(n).cast("long")) if sized else df
        df = df.where(kept).drop(pos, size)
    return df


def _seen(df: DataFrame, order: list[str], within: list[str], test: Column, to: int, wanted: int) -> DataFrame:
    seen = fresh(df, "_seen")
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, to)
    return df.withColumn(seen, F.coalesce(F.max(test.cast("int")).over(w), F.lit(0))).where(F.col(seen) == wanted).drop(seen)


def before_first(df: DataFrame, order: list[str], within: list[str], test: Column, inclusive: bool = False) -> DataFrame:
    """Items before the first that satisfies test, with it if inclusive."""
    return _seen(df, order, within, test, -1 if inclusive else 0, 0)


def from_first(df: DataFrame, order: list[str], within: list[str], test: Column, inclusive: bool = True) -> DataFrame:
    """Items from the first that satisfies test on, without it unless inclusive."""
    return _seen(df, order, within, test, 0 if inclusive else -1, 1)


def members(df: DataFrame, array: str, item: str = "item", at: str = "at") -> DataFrame:
    """One row for each member of an array column, with its position from 1; empty and null arrays give none."""
    rest = [c for c in df.columns if c != array]
    place = fresh(df, "_at")
    return df.select(*rest, F.posexplode(array).alias(place, item)).withColumn(at, (F.col(place) + 1).cast("long")).drop(place)


def entries(df: DataFrame, mapping: str) -> DataFrame:
    """One row for each entry of a map column."""
    rest = [c for c in df.columns if c != mapping]
    return df.select(*rest, F.explode(mapping).alias("key", "value"))
