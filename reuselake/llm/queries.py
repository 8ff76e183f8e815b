"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reuselake.llm import bpe, dartminhash, decontam, hardneg, langid, linededup, phrases, pii, quality, rules, sharding, suffix, toxicity
from reuselake.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.digest(table(spark, sf_dir, "documents"))


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), key="op6")


def op7_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hat_trie_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(table(spark, sf_dir, "documents"))


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_cgk_decontamination, op3_run_length_index, op4_dart_minhash, op5_line_edit_join, op6_feistel_pseudonyms, op7_word_table_bpe,
        op8_stratified_shards, op9_quality_rules, op10_quality_trees, op11_ftrl_toxicity, op12_hat_trie_phrases, op13_residue_negatives,
    )
}
ORACLES: dict[str, str] = {"op12_hat_trie_phrases": phrases.ORACLE_SQL, "op13_residue_negatives": hardneg.ORACLE_SQL}
