"""JSON in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.atomize import double_text


def parse(c: Column, schema: str) -> Column:
    """Text to a typed value; text that is no JSON gives empty."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def variant(c: Column) -> Column:
    """Text to a value of any shape; empty if it is no JSON."""
    return F.try_parse_json(c)


def lookup(c: Column, path: str, kind: str = "string") -> Column:
    """A value by path such as $.a[0]; empty if it is not there or of another kind."""
    return F.try_variant_get(c, path, kind)


def serialize(c: Column) -> Column:
    """A struct, map or array as JSON; '/' as \\/ ."""
    return F.replace(F.to_json(c), F.lit("/"), F.lit("\\/"))


def canonical_number(lexical: Column) -> Column:
    """A number in its short form: no leading zeros, digits on both sides of the point, exponent as E; -0 stays."""
    n = F.trim(lexical).try_cast("double")
    size = F.abs(n)
    plain = F.regexp_replace(F.regexp_replace(n.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    zero = F.when(F.trim(lexical).startswith("-"), "-0").otherwise("0")
    return F.when(n == 0, zero).when((size >= 1e-6) & (size < 1e6), plain).otherwise(double_text(n))
