"""Atomic values: effective boolean value, numbers out of untyped text, rounding and text forms.

An empty sequence is NULL for single values and ``[]`` for sequences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")


def number(c: Column) -> Column:
    """The value as a double; text that is no number, and the empty sequence, give NaN."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(NAN))


def numeric(c: Column) -> Column:
    """The value as a double; text that is no number gives NULL, so aggregates skip it."""
    return F.trim(c.cast("string")).try_cast("double")


def ebv(c: Column, kind: T.DataType) -> Column:
    """Effective boolean value by type: empty, false, '', 0 and NaN are false; a sequence is true if it has items."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounding with ties towards positive infinity: -2.5 gives -2."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5).cast("double") / scale


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def decimal_text(c: Column) -> Column:
    """A decimal without trailing zeros; minus zero is 0."""
    plain = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)


def double_text(c: Column) -> Column:
    """A double as the query language prints it: plain between 1e-6 and 1e6, else with an exponent; INF, -INF, NaN."""
    size = F.abs(c)
    plain = decimal_text(c.cast("decimal(38,18)"))
    # seven digits before the point are still plain in Spark's text: the point moves by six places
    digits = F.regexp_replace(F.replace(F.abs(c).cast("string"), F.lit(".")), "0+$", "")
    rest = F.substring(digits, 2, 40)
    moved = F.concat(F.when(c < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.lit("."), F.when(rest == "", "0").otherwise(rest), F.lit("E6"))
    return (
        F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF")
        .when(c == 0, "0").when((size >= 1e-6) & (size < 1e6), plain).when((size >= 1e6) & (size < 1e7), moved).otherwise(c.cast("string"))
    )


def text(c: Column, kind: T.DataType) -> Column:
    """The string value of an atomic value, of a sequence the items joined by a space; empty gives ''."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: text(x, kind.elementType)), " ")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        out = double_text(c.cast("double"))
    elif isinstance(kind, T.DecimalType):
        out = decimal_text(c)
    elif isinstance(kind, T.TimestampType):
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def general_equal(a: Column, b: Column) -> Column:
    """Existential comparison of two sequences: true if any pair is equal; an empty sequence compares false."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def general_compare(a: Column, b: Column, test) -> Column:
    """True if test holds for any pair of items."""
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: F.coalesce(test(x, y), F.lit(False)))), F.lit(False))


def concat(*parts: Column) -> Column:
    """Text concatenation in which the empty sequence is ''."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
