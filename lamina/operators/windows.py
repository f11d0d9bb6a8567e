"""Running values: accumulators, numbering, iteration with early exit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.grouping import _needs_key
from lamina.operators.names import fresh


def accumulator(df: DataFrame, aggregate: Column, order: list[str], within: list[str], name: str = "acc", start: Column | None = None) -> DataFrame:
    """df with ``name_before`` and ``name_after``: the aggregate over the items before, and over those up to and with, each item.

    start is the value before the first item."""
    w = Window.partitionBy(*within).orderBy(*order)
    none = F.lit(0) if start is None else start
    return df.withColumn(f"{name}_before", F.coalesce(aggregate.over(w.rowsBetween(Window.unboundedPreceding, -1)), none)).withColumn(f"{name}_after", F.coalesce(aggregate.over(w.rowsBetween(Window.unboundedPreceding, 0)), none))


def last_seen(value: Column, when: Column, order: list[str], within: list[str]) -> Column:
    """The value at the latest item, this one included, for which ``when`` holds."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(when, value), ignorenulls=True).over(w)


def number_single(order: list[str], parent: list[str], match: Column | None = None) -> Column:
    """level=single: the ordinal among matching siblings."""
    w = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.lit(1) if match is None else match.cast("int")).over(w).cast("long")


def number_any(df: DataFrame, match: Column, order: list[str], within: list[str], start: Column | None = None, name: str = "number") -> DataFrame:
    """level=any: how many matching items came since the latest item where ``start`` holds, this one included."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if start is None:
        return df.withColumn(name, F.sum(match.cast("int")).over(w).cast("long"))
    since = fresh(df, "_since")
    marked = df.withColumn(since, F.sum(start.cast("int")).over(w))
    inner = Window.partitionBy(*within, since).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum(match.cast("int")).over(inner).cast("long")).drop(since)


def number_multiple(*levels: Column) -> Column:
    """level=multiple: the ordinals of the item and its ancestors, outermost first."""
    return F.array(*levels)


def iterate(df: DataFrame, columns: list[str], order: list[str], within: list[str], start: Column, step: Callable[[Column, Column], Column], done: Callable[[Column], Column], finish: Callable[[Column], Column] | None = None, name: str = "result") -> DataFrame:
    """A fold with early exit for each group, inside generated code: once done(state) holds the state no longer changes."""
    _needs_key(within)
    items = F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))
    state = F.aggregate(items, start, lambda s, x: F.when(done(s), s).otherwise(step(s, x)))
    grouped = df.groupBy(*within).agg(state.alias(name))
    return grouped.withColumn(name, finish(F.col(name))) if finish else grouped


def iterate_rows(df: DataFrame, order: list[str], within: list[str], body: Callable[[tuple, Iterator], Iterator[dict]], schema: str) -> DataFrame:
    """A fold in Python for states that expressions cannot hold: body gets a group's key and its rows as named tuples in order, and yields
    rows; it may stop early.  A group must fit a task."""
    _needs_key(within)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable").itertuples(index=False)
        return pd.DataFrame(list(body(key, rows)))

    return df.groupBy(*within).applyInPandas(run, schema)
