"""Aggregates over sequences, folds, and several aggregates in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.atomize import numeric


def total(c: Column, zero: Column | None = None) -> Column:
    """Sum; of no items 0, or ``zero``."""
    return F.coalesce(F.sum(c), F.lit(0) if zero is None else zero)


def mean_of_numbers(c: Column) -> Column:
    """Average of what is a number; other text is skipped; of none, empty."""
    return F.avg(numeric(c))


def least_number(c: Column) -> Column:
    return F.min(numeric(c))


def greatest_number(c: Column) -> Column:
    return F.max(numeric(c))


def string_join(c: Column, order: Column | str, separator: str = "") -> Column:
    """The items as text in order, with a separator between them; of none ''."""
    pairs = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct((F.col(order) if isinstance(order, str) else order).alias("_at"), c.cast("string").alias("_text")))))
    return F.array_join(F.transform(pairs, lambda p: p["_text"]), separator)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values; NaN equals NaN, and the empty sequence is no value."""
    out = df.select(*columns).distinct()
    return out.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else out


def count_where(test: Column) -> Column:
    return F.count_if(test)


def total_where(c: Column, test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, c)), F.lit(0))


def exists(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def exactly_one(c: Column, what: str = "item") -> Column:
    """The one value of a group; raises if there is none or more than one."""
    n = F.count(c)
    return F.when(n == 1, F.min(c)).otherwise(F.raise_error(F.concat(F.lit(f"exactly one {what} expected, found "), n.cast("string"))))


def zero_or_one(c: Column, what: str = "item") -> Column:
    n = F.count(c)
    return F.when(n <= 1, F.min(c)).otherwise(F.raise_error(F.concat(F.lit(f"at most one {what} expected, found "), n.cast("string"))))


def one_or_more(c: Column, what: str = "item") -> Column:
    return F.when(F.count(c) > 0, F.collect_list(c)).otherwise(F.raise_error(F.lit(f"at least one {what} expected")))


def fork(df: DataFrame, **prongs: Column) -> DataFrame:
    """Several aggregates of a table in one pass."""
    return df.agg(*(c.alias(n) for n, c in prongs.items()))


def fork_groupings(df: DataFrame, groupings: dict[str, list[str]], **aggregates: Column) -> DataFrame:
    """Several groupings of one pass over the table: GROUPING SETS.  ``prong`` names the grouping, columns of others are NULL."""
    columns = list(dict.fromkeys(c for g in groupings.values() for c in g))
    out = df.groupingSets([[F.col(c) for c in g] for g in groupings.values()], *(F.col(c) for c in columns)).agg(F.grouping_id().alias("_id"), *(a.alias(n) for n, a in aggregates.items()))
    name = F.lit(None).cast("string")
    for prong, g in groupings.items():
        code = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in g)
        name = F.when(F.col("_id") == code, prong).otherwise(name)
    return out.withColumn("prong", name).drop("_id")


def fold_left(order: list[str], columns: list[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """A fold over a group's items in order.  step: (state, item struct) to state.  A group must fit a task, as any ordered fold must."""
    items = F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))
    return F.aggregate(items, start, step, finish) if finish else F.aggregate(items, start, step)


def fold_right(order: list[str], columns: list[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """The fold from the last item to the first; step gets (state, item)."""
    items = F.reverse(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))))
    return F.aggregate(items, start, step, finish) if finish else F.aggregate(items, start, step)
