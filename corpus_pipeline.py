"""The corpus pipeline: five stages over ``documents``, each a training-data operator at production parameters.

A stage reads all its predecessor kept, and its decisions take effect: rows that it rejects are gone. Every stage but
the last returns the columns of ``documents``. Each result is written as Parquet and read again by the next stage.

A null text counts as empty and fails the rules, as does one of less than 50 words. Rows with a null id are judged as
others are; where one of several has to stay, they come after all ids. Repeated rows are copies of each other. Labels
of null ids teach nothing. Empty tables give an empty result, and columns beside those used may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, ngram_join, packing, quality_cnn, quality_rules
from tessera.llm.common import table, written
from tessera.llm.queries import trusted_ids

#: Near-duplicate documents share this part of their distinct 5-word shingles.
NEAR = ngram_join.Rule(size=5, num=80, den=100)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs, trusted_ids(spark, sf_dir))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows of the whole table: the stage before leaves next to none of label 0."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs, NEAR)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_crc32(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
