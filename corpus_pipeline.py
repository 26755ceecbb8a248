"""From raw documents to token ids: the stages of a training-data pipeline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from paywarden.llm import chosen_path, kneser_ney, mixing, rules, sentencepiece
from paywarden.llm.common import table, written

#: The tokenizer's model file.
TOKENIZER = os.environ.get("CORPUS_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    return rules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose perplexity under trusted text is usual for their language."""
    return kneser_ney.keep(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return chosen_path.keep(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as piece ids."""
    return sentencepiece.encoded(docs, TOKENIZER, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece_ids),
]

#: The classifier's model and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the whole documents table, each written before the next one reads it."""
    docs = table(spark, folder, "documents")
    for place, (name, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, folder)
        if place < len(STAGES):
            docs = written(docs, name)
    return docs
