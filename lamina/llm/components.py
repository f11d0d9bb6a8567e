"""Connected components of a link table, by repeated contraction.

Every round each node joins its smallest neighbour if that is smaller, then links are renamed and those inside a node vanish.  Node
names are hashes, so chains of ever smaller names are short and a few rounds do; unions happen in tables, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import deleted, written


def contracted(links: DataFrame, name: str = "links") -> DataFrame:
    """links: (a, b) as longs.  Returns (node, label) for every linked node; nodes of one component, and no others, share the label."""
    spark = links.sparkSession
    edges = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = None
    while edges.take(1):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
        # a node's parent may have a parent: look up twice, which keeps rounds few
        up = parent.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step = written(parent.join(up, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label")), name)
        last = edges
        edges = _renamed(_renamed(edges, "a", step), "b", step).where("a != b")
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        if labels is None:
            labels = step
            deleted(spark, last)
        else:
            old, labels = labels, written(_renamed(labels, "label", step), name)
            deleted(spark, last, old, step)
    deleted(spark, edges)
    return spark.createDataFrame([], "node long, label long") if labels is None else labels


def _renamed(df: DataFrame, col: str, by: DataFrame) -> DataFrame:
    """df with col's values replaced by their labels where they have one."""
    by = by.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    rest = [c for c in df.columns if c != col]
    return df.join(by, df[col] == by["_node"], "left").select(*rest, F.coalesce("_label", col).alias(col)).select(*df.columns)
