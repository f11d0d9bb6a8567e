"""Grouping: by value in order of first appearance, and by position (runs, starts, ends).

Unlike SQL, an item whose key is the empty sequence joins no group, and an item with several keys joins the group of each distinct one.
Positional grouping takes place inside ``within``; a run over a whole table has no key to distribute by, so it is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.names import fresh


def group_by(df: DataFrame, keys: dict[str, Column], order: list[str], **aggregates: Column) -> DataFrame:
    """Groups with their aggregates and ``first_seen``, the order values of the earliest member; sort by it for order of appearance.

    With one key, NULL is the empty sequence and its items drop out; several keys make a composite key, of which any part may be empty."""
    out = df.select("*", *(k.alias(f"_k_{n}") for n, k in keys.items()))
    if len(keys) == 1:
        out = out.where(F.col(f"_k_{next(iter(keys))}").isNotNull())
    seen = F.min(F.struct(*order) if len(order) > 1 else F.col(order[0])).alias("first_seen")
    return out.groupBy(*(F.col(f"_k_{n}").alias(n) for n in keys)).agg(*(a.alias(n) for n, a in aggregates.items()), seen)


def group_by_each(df: DataFrame, keys: Column, order: list[str], name: str = "key", **aggregates: Column) -> DataFrame:
    """Groups by a sequence of keys: an item joins the group of each distinct key once; no keys, no group."""
    each = fresh(df, "_each")
    return group_by(df.withColumn(each, F.explode(F.array_distinct(keys))), {name: F.col(each)}, order, **aggregates)


def current_group(order: list[str], *columns: str) -> Column:
    """The members as an array of structs in population order; the struct begins with the order columns."""
    return F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))


def _needs_key(within: list[str]) -> None:
    if not within:
        raise ValueError("positional grouping needs columns to group within: a run over a whole table cannot be distributed")


def adjacent(df: DataFrame, key: Column, order: list[str], within: list[str], name: str = "group") -> DataFrame:
    """df with the number of each item's run of equal keys, from 1 inside ``within``; two empty keys are equal."""
    _needs_key(within)
    w = Window.partitionBy(*within).orderBy(*order)
    change = (~key.eqNullSafe(F.lag(key).over(w))) | (F.row_number().over(w) == 1)
    mark = fresh(df, "_change")
    marked = df.withColumn(mark, change.cast("int"))
    return marked.withColumn(name, F.sum(mark).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop(mark)


def starting_with(df: DataFrame, match: Column, order: list[str], within: list[str], name: str = "group") -> DataFrame:
    """A group begins at each item that matches, and with the first item."""
    _needs_key(within)
    w = Window.partitionBy(*within).orderBy(*order)
    begins = F.coalesce(match, F.lit(False)) | (F.row_number().over(w) == 1)
    mark = fresh(df, "_begins")
    marked = df.withColumn(mark, begins.cast("int"))
    return marked.withColumn(name, F.sum(mark).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop(mark)


def ending_with(df: DataFrame, match: Column, order: list[str], within: list[str], name: str = "group") -> DataFrame:
    """A group ends after each item that matches."""
    _needs_key(within)
    w = Window.partitionBy(*within).orderBy(*order)
    mark = fresh(df, "_ends")
    marked = df.withColumn(mark, F.coalesce(match, F.lit(False)).cast("int"))
    return marked.withColumn(name, (1 + F.coalesce(F.sum(mark).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long")).drop(mark)
