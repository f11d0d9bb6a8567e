"""The queries of the training-data operators, by key, and their SQL twins; the pipeline of them is added where both are read."""

from __future__ import annotations

from lamina.llm import additive_model, bpe, chat, decision_list, katz, mixing, multi_index, near_dup, secrets, sentence_dedup
from lamina.llm.common import table
from lamina.llm.oracles import ORACLES


def op1_quality_classifier(spark, sf_dir):
    return additive_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentence_dedup(spark, sf_dir):
    return sentence_dedup.report(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"))


def op4_multi_index(spark, sf_dir):
    return multi_index.report(table(spark, sf_dir, "embeddings"))


def op5_katz_backoff(spark, sf_dir):
    return katz.report(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


def op8_near_dup(spark, sf_dir):
    return near_dup.report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return decision_list.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_curriculum_mix(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_sentence_dedup, op3_byte_bpe, op4_multi_index, op5_katz_backoff, op6_secret_scan, op7_chat_format, op8_near_dup, op9_quality_rules, op10_curriculum_mix)}
__all__ = ["ORACLES", "QUERIES"]
