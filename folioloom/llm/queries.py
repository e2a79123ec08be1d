"""Queries of the training-data operators: their names, callables and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, pii, quality, repair, simhash, suffix_dedup, toxicity, trie_bpe, url_lists


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_read(spark, sf_dir, "documents"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.filtered_pages(_read(spark, sf_dir, "pages"), url_lists.entries(spark))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.token_digests(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.digests(chat.examples(turns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_quality_rules, op4_suffix_dedup, op5_url_lists, op6_decontamination, op7_trie_bpe, op8_token_files, op9_chat, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_lists": url_lists.ORACLE, "op6_decontamination": decontaminate.ORACLE, "op9_chat": chat.ORACLE}
