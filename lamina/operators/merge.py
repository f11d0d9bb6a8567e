"""Merging k ordered sources: one group for each distinct key, in key order, with its items source by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MergeError(ValueError):
    """The sources' keys do not agree."""


def merged(sources: dict[str, tuple[DataFrame, list[Column], list[str]]], columns: list[str], names: list[str]) -> DataFrame:
    """sources: name to (table, key columns, order columns); columns: what items carry, in every source; names: the key columns' names.

    Result: the keys, ``current``, the items as an array of structs (rank of source, order, source, columns) in merge order, and a count for each
    source.  Keys and order columns must have the same number and types in every source.  Inputs need no order: the exchange sorts."""
    kinds = {tuple(df.select(*keys).dtypes[i][1] for i in range(len(keys))) for df, keys, _ in sources.values()}
    if len(kinds) > 1:
        raise MergeError(f"merge keys differ in number or type: {sorted(kinds)}")
    tagged = None
    for rank, (name, (df, keys, order)) in enumerate(sources.items()):
        part = df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.struct(F.lit(rank).alias("rank"), F.struct(*order).alias("order"), F.lit(name).alias("source"), *columns).alias("_item"), F.lit(name).alias("_source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    of_source = [F.count_if(F.col("_source") == n).alias(f"n_{n}") for n in sources]
    return tagged.groupBy(*names).agg(F.array_sort(F.collect_list("_item")).alias("current"), *of_source)


def merge_group(source: str) -> Column:
    """The items of one source in a merge group."""
    return F.filter("current", lambda x: x["source"] == source)


def counts(sources: dict[str, tuple[DataFrame, list[Column]]], names: list[str]) -> DataFrame:
    """For each distinct key how many items each source has: the merge without its items, which aggregates before the shuffle."""
    tagged = None
    for name, (df, keys) in sources.items():
        part = df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.lit(name).alias("source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(*names).agg(*(F.count_if(F.col("source") == n).alias(f"n_{n}") for n in sources))


def single_key(keys: Column) -> Column:
    """The only value of a key sequence; raises if it has more."""
    return F.when(F.size(keys) <= 1, F.try_element_at(keys, F.lit(1))).otherwise(F.raise_error(F.lit("a merge key has more than one value")))
