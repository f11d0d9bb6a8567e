"""Choices, fallbacks and checks as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first branch whose test holds."""
    out = None
    for test, value in branches:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise) if otherwise is not None else out


def switch(subject: Column, cases: dict, otherwise: Column | None = None) -> Column:
    """The value of the case that equals the subject."""
    return choose(*((subject == F.lit(k), v) for k, v in cases.items()), otherwise=otherwise)


def attempt(value: Column, *fallbacks: Column) -> Column:
    """try/catch of a row: value must be one of Spark's try_ forms, which give NULL on failure."""
    return F.coalesce(value, *fallbacks)


def attempt_query(body, *catch: tuple[type[BaseException] | tuple, object]):
    """try/catch of a whole query: body() runs; on an error of a kind the handler gets it."""
    try:
        return body()
    except Exception as error:
        for kind, handler in catch:
            if isinstance(error, kind):
                return handler(error)
        raise


def where_populated(df: DataFrame, *content: str) -> DataFrame:
    """Only rows of which some content is not empty."""
    test = F.lit(False)
    for c in content:
        kind = dict(df.dtypes)[c]
        full = F.size(c) > 0 if kind.startswith(("array", "map")) else F.length(F.col(c).cast("string")) > 0
        test = test | F.coalesce(full, F.lit(False))
    return df.where(test)


def on_empty(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """df, or fallback if df has no rows; one plan, decided when it runs."""
    none = df.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return df.unionByName(fallback.join(F.broadcast(none)).drop("_n"))


def on_non_empty(df: DataFrame, extra: DataFrame) -> DataFrame:
    """df and, only if it has rows, extra."""
    some = df.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return df.unionByName(extra.join(F.broadcast(some)).drop("_n"))


def checked(df: DataFrame, test: Column, message: str) -> DataFrame:
    """df; reading a row for which the test does not hold raises."""
    return df.where(F.assert_true(F.coalesce(test, F.lit(False)), message).isNull())
