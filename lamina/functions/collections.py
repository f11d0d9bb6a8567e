"""Maps and arrays, and functions over them.

An ordered map, in which the order of entries shows, is an array of (key, value) structs; a plain MapType serves where only lookup counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- ordered maps


def ordered_map(pairs: list[tuple[Column, Column]]) -> Column:
    return F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in pairs))


def get(m: Column, key: Column) -> Column:
    """The value of a key; empty if it is not there."""
    return F.get(F.filter(m, lambda e: e["key"] == key), F.lit(0))["value"]


def put(m: Column, key: Column, value: Column) -> Column:
    """An existing key keeps its place, a new one comes last."""
    replaced = F.transform(m, lambda e: F.when(e["key"] == key, F.struct(e["key"].alias("key"), value.alias("value"))).otherwise(e))
    return F.when(contains(m, key), replaced).otherwise(F.concat(m, F.array(F.struct(key.alias("key"), value.alias("value")))))


def contains(m: Column, key: Column) -> Column:
    return F.exists(m, lambda e: e["key"] == key)


def remove(m: Column, key: Column) -> Column:
    return F.filter(m, lambda e: e["key"] != key)


def keys(m: Column) -> Column:
    return F.transform(m, lambda e: e["key"])


def values(m: Column) -> Column:
    return F.transform(m, lambda e: e["value"])


def merge(*maps: Column, use: str = "use-first") -> Column:
    """Maps in one, with the first or the last value of a key that repeats; keys stand where they first appear."""
    flat = F.concat(*maps)
    names = F.array_distinct(keys(flat))
    at = F.lit(1) if use == "use-first" else F.lit(-1)
    return F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(flat, lambda e: e["key"] == k), at)["value"].alias("value")))


# --- plain maps


def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_find(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def map_for_each(m: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.map_entries(m), lambda e: f(e["key"], e["value"]))


# --- arrays


def head(a: Column) -> Column:
    return F.get(a, F.lit(0))


def tail(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def subarray(a: Column, start: int, length: int | None = None) -> Column:
    return F.slice(a, F.lit(start), F.lit(length) if length is not None else F.greatest(F.size(a) - (start - 1), F.lit(0)))


def append(a: Column, item: Column) -> Column:
    return F.concat(a, F.array(item))


def insert_before(a: Column, at: int, item: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), F.lit(at - 1)), F.array(item), F.slice(a, F.lit(at), F.greatest(F.size(a) - at + 1, F.lit(0))))


def remove_at(a: Column, at: int) -> Column:
    return F.filter(a, lambda x, i: i != at - 1)


def index_of(a: Column, item: Column) -> Column:
    """All positions of an item, from 1."""
    return F.filter(F.transform(a, lambda x, i: F.when(x == item, i + 1)), lambda p: p.isNotNull())


def for_each(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def for_each_pair(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """As many results as the shorter sequence has items."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def select(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: F.coalesce(test(x), F.lit(False)))


def fold_left(a: Column, zero: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, zero, f)


def fold_right(a: Column, zero: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f gets (item, state)."""
    return F.aggregate(F.reverse(a), zero, lambda s, x: f(x, s))


def sort(a: Column, key: Callable[[Column], Column] | None = None) -> Column:
    """Ascending and stable, by a key function if there is one."""
    if key is None:
        return F.array_sort(a)
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda e: e["x"])


def flatten(a: Column) -> Column:
    return F.flatten(a)


def deep_equal(a: Column, b: Column) -> Column:
    """Equality of whole values; two empty sequences are equal."""
    return a.eqNullSafe(b)


def some(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(a, test), F.lit(False))


def every(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(a, test), F.lit(True))


def distinct(a: Column) -> Column:
    return F.array_distinct(a)
