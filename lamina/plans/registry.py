"""The engine's own queries and their SQL twins, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute: t.orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None = None) -> Callable:
    """Registers a function of Tables under its name, with its SQL twin if it has one."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(ship(spark), folder))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


from lamina.plans import components, grouping, navigation, projection, rules, scalars, streams, trees  # noqa: E402, F401  they register themselves
