"""User functions: expressions by name, vectorised functions, table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Functions:
    """A registry by name and arity; later definitions override, and ``original`` reaches what they override."""

    def __init__(self, parent: Functions | None = None):
        self.parent, self.own = parent, {}

    def define(self, name: str, f: Callable[..., Column], arity: int | None = None) -> None:
        self.own[(name, f.__code__.co_argcount if arity is None else arity)] = f

    def lookup(self, name: str, arity: int) -> Callable[..., Column] | None:
        """The function, or None: function-lookup."""
        return self.own.get((name, arity)) or (self.parent.lookup(name, arity) if self.parent else None)

    def original(self, name: str, arity: int) -> Callable[..., Column] | None:
        return self.parent.lookup(name, arity) if self.parent else None

    def names(self) -> set[tuple[str, int]]:
        """All names with their arities."""
        return set(self.own) | (self.parent.names() if self.parent else set())

    def call(self, name: str, *args: Column) -> Column:
        f = self.lookup(name, len(args))
        if f is None:
            raise LookupError(f"no function {name} of {len(args)} arguments")
        return f(*args)


def sql_function(spark: SparkSession, name: str, signature: str, returns: str, body: str) -> None:
    """A function in SQL, inlined into the plan: sql_function(spark, 'net', 'p DOUBLE, d DOUBLE', 'DOUBLE', 'p * (1 - d)')."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {returns} RETURN {body}")


def evaluate(expression: str) -> Column:
    """A trusted expression that is known only when the query is built."""
    return F.expr(expression)


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.IntegerType())]))
class WordsTemplate:
    """A template that gives 0 to n rows for an item: the words of a text with their positions."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split(), 1):
            yield w, i
