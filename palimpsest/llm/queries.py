"""The registered queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, common, oracles
from palimpsest.llm.chat import format_chats
from palimpsest.llm.decontaminate import contamination
from palimpsest.llm.main_text import extract
from palimpsest.llm.near_dup import near_duplicates
from palimpsest.llm.quality import quality
from palimpsest.llm.substring_dedup import without_repeats
from palimpsest.llm.token_counts import token_counts
from palimpsest.llm.token_files import token_files
from palimpsest.llm.weak_labels import classify


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files(common.read(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.read(spark, sf_dir, "conversations"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(common.read(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_main_text,
        op3_decontamination,
        op4_substring_dedup,
        op5_token_counts,
        op6_quality_rules,
        op7_chat_format,
        op8_near_dedup,
        op9_quality_classifier,
        op10_bpe,
        base_quality_rules,
    )
}

#: Of the others, tests/llm compares each with a brute-force version or a library.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": oracles.OP3,
    "op4_substring_dedup": oracles.OP4,
    "op8_near_dedup": oracles.OP8,
    "base_quality_rules": oracles.BASE_RULES,
}
