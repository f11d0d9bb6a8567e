"""Set operations on items by identity, and on nested items by containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.names import fresh


def union(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    """Items of either, each once."""
    return a.unionByName(b).dropDuplicates(identity)


def intersect(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    return a.dropDuplicates(identity).join(b.select(*identity).distinct(), identity, "left_semi")


def difference(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    return a.dropDuplicates(identity).join(b.select(*identity).distinct(), identity, "left_anti")


def outermost(nodes: DataFrame, doc: str = "doc_id", pre: str = "pre", post: str = "post") -> DataFrame:
    """Nodes without a selected ancestor.

    In document order the nearest possible ancestor of a node is the one with the greatest end so far, so a running maximum decides."""
    w = Window.partitionBy(doc).orderBy(pre).rowsBetween(Window.unboundedPreceding, -1)
    reach = fresh(nodes, "_reach")
    return nodes.withColumn(reach, F.max(post).over(w)).where(F.col(reach).isNull() | (F.col(reach) < F.col(post))).drop(reach)


def innermost(nodes: DataFrame, doc: str = "doc_id", pre: str = "pre", post: str = "post") -> DataFrame:
    """Nodes without a selected descendant: the next selected node in document order lies outside."""
    w = Window.partitionBy(doc).orderBy(pre)
    after = fresh(nodes, "_next")
    return nodes.withColumn(after, F.lead(post).over(w)).where(F.col(after).isNull() | (F.col(after) > F.col(post))).drop(after)
