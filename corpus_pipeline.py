"""A corpus from raw documents to token ids: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and all that the one before has kept.
Between stages the documents are written as Parquet in the shared folder and
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, common
from palimpsest.llm.decontaminate import keep_uncontaminated
from palimpsest.llm.near_dup import keep_one_each
from palimpsest.llm.quality import keep_good
from palimpsest.llm.substring_dedup import keep_rest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near-duplicates."""
    return keep_one_each(docs)


#: Passages of over 50 words are to go: of 51 words in a row 99 % have this many bytes or more.
PASSAGE_BYTES = 250


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``PASSAGE_BYTES`` bytes that occur elsewhere as well."""
    return keep_rest(docs, length=PASSAGE_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return keep_uncontaminated(docs, common.read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: how many, and digests of the ids and of their decoded text."""
    return bpe.digests(bpe.encode(docs, common.tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can express neither the outlier estimates nor the token ids; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
