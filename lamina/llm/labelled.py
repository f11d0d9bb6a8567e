"""Bounded training samples from the labels table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import held_out
from lamina.llm.text_stats import COUNTS, SHARES, with_statistics

#: At most so many labelled documents train a model; those whose hashed ids are smallest.  A documented bound, the same at every size.
SAMPLE = 20_000
#: Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2.
FOLDS = 4
FEATURES = (*SHARES,)


def sample(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(features, label 0/1) of at most limit documents that may train.  Repeated labels of a document count by their mean; null labels do not count."""
    chosen = (
        labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), FOLDS))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(texts).select("doc_id", "_label", "_stats.*").drop("text").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(limit).toPandas()
    return rows[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES)), rows["_label"].to_numpy(np.int64)
