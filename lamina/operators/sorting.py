"""Sorting by several keys with the language's rules, and the first items of an order."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.atomize import number
from lamina.operators.names import fresh
from lamina.session import shared_folder


@dataclass(frozen=True)
class SortKey:
    """One key: text by code points, or by a collation; numbers with NaN lowest; the empty sequence first when ascending, last when descending."""

    by: Column
    descending: bool = False
    numeric: bool = False
    collation: str | None = None

    def columns(self) -> list[Column]:
        key = self.by
        if self.numeric:
            n = number(key)
            flag, value = ~F.isnan(n), F.when(~F.isnan(n), n)
            keys = [flag, value]
        else:
            keys = [F.collate(key, self.collation) if self.collation else key]
        return [k.desc_nulls_last() if self.descending else k.asc_nulls_first() for k in keys]


def perform_sort(df: DataFrame, keys: list[SortKey], stable: list[str]) -> DataFrame:
    """df in the order of the keys; ``stable``: columns that give the order of population, for ties."""
    return df.orderBy(*(c for k in keys for c in k.columns()), *stable)


def numbered(df: DataFrame, keys: list[SortKey], stable: list[str], name: str = "pos") -> DataFrame:
    """All of df with each row's position from 1 in the order of the keys; sorted by ranges, so no task holds it all.

    The sorted rows are a table of the shared folder with their ranges' numbers, so that counts and rows are of one and the same sort."""
    spark, at, before = df.sparkSession, fresh(df, "_at"), fresh(df, "_before")
    path = f"{shared_folder(spark)}/lamina/sorted-{uuid.uuid4().hex}"
    # the number that Spark gives holds a row's partition above its place there
    perform_sort(df, keys, stable).withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(at, T.LongType())])).parquet(path)
    part = F.shiftright(at, 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range of the sort
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", ahead.alias(before))
    joined = rows.join(F.broadcast(counts), part == counts["_part"])
    return joined.select(*df.columns, (F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before) + 1).cast("long").alias(name))


def top_k(df: DataFrame, keys: list[SortKey], stable: list[str], k: int, within: list[str] | None = None) -> DataFrame:
    """The first k items; of each group if ``within`` is given, where Spark keeps k rows of a group before the shuffle."""
    order = [c for key in keys for c in key.columns()] + [F.col(s) for s in stable]
    if not within:
        return df.orderBy(*order).limit(k)
    rank = fresh(df, "_rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col(rank) <= k).drop(rank)
