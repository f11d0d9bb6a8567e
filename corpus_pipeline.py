"""From raw documents to token ids: quality rules, near-dedup, secret redaction, mixing by a curriculum, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each one's rows as Parquet in the shared folder and reads them
again, so a lost executor costs one stage's tasks at most; a stage's table goes once the next one is written.  Stages cannot be expressed in SQL (learned rules, sketches, forests, merges), so
``ORACLE_SQL`` is None; tests hold each against a brute-force version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import bpe, decision_list, mixing, near_dup, secrets
from lamina.llm.common import deleted, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return decision_list.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return near_dup.one_of_each(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a placeholder in the text."""
    return secrets.redacted(docs)


def curriculum_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of training."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return bpe.encoded(docs, lean=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("curriculum_mix", curriculum_mix), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        deleted(spark, *own)
        own = [docs]
    return docs
