"""Joins as the language expresses them: key indexes, ids, membership, lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.names import fresh

#: A lookup table is broadcast if it has at most so many rows, else Spark joins by shuffle.
LOOKUP_ROWS = 200_000


@dataclass(frozen=True)
class Key:
    """A named index: items that match, by the value or values of ``use``.  Several definitions of a name add up."""

    df: DataFrame
    use: tuple[Column, ...]
    many: bool = False

    def indexed(self) -> DataFrame:
        """The items with their key columns _k0, _k1, ..; with ``many`` the one use is a sequence and an item has a row for each distinct value."""
        if self.many:
            return self.df.select("*", F.explode(F.array_distinct(self.use[0])).alias("_k0"))
        return self.df.select("*", *(u.alias(f"_k{i}") for i, u in enumerate(self.use)))


def key_lookup(probe: DataFrame, key: Key, values: tuple[Column, ...], how: str = "inner") -> DataFrame:
    """Each probe row with the items whose key equals its values.  Empty keys match nothing."""
    index = key.indexed()
    test = None
    for i, v in enumerate(values):
        equal = v == index[f"_k{i}"]
        test = equal if test is None else test & equal
    out = probe.join(index, test, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_k{i}" for i in range(len(values))))


def key_lookup_any(probe: DataFrame, key: Key, values: Column, identity: list[str]) -> DataFrame:
    """Items found for any value of a sequence, once for each probe row; identity: columns that tell pairs of rows apart."""
    value = fresh(probe, "_value")
    exploded = probe.withColumn(value, F.explode(F.array_distinct(values)))
    return key_lookup(exploded, key, (F.col(value),)).drop(value).dropDuplicates(identity)


def matching(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The items for which the other sequence holds an equal one: existential comparison."""
    return df.join(other.select(*on).distinct() if other.columns != on else other, on, "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """A map used as a lookup table: left join, broadcast only if the counted table is small."""
    small = table.count() <= LOOKUP_ROWS
    return df.join(F.broadcast(table) if small else table, on, "left")


def nested(outer: DataFrame, inner: DataFrame, test: Column) -> DataFrame:
    """A loop inside a loop with a correlated predicate; give equalities in the test where there are any, for they decide how it runs."""
    return outer.join(inner, test, "inner")
