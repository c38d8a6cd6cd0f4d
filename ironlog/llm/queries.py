"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ironlog.llm import bpe, divergence, exact_dedup, hard_negatives, html_text, merkle, minhash_forest, mixture, ngram_lm, quality, sharding, vector_dups, warc
from ironlog.llm.common import table


RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), shards=16)


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"))


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"))


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op11_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.verdicts(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def op13_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_additive_quality, op2_byte_shards, op3_chunk_recipes, op4_byte_bpe, op5_elias_fano_lm, op6_line_blocks, op7_warc_salvage,
        op8_projection_forest, op9_source_mixture, op10_minhash_forest, op11_distribution_divergence, op12_merkle_manifest, op13_strassen_negatives,
    )
    return {f.__name__: f for f in found}


def statements() -> dict[str, str]:
    return {
        "op3_chunk_recipes": exact_dedup.ORACLE, "op7_warc_salvage": warc.ORACLE, "op11_distribution_divergence": divergence.ORACLE,
        "op12_merkle_manifest": merkle.ORACLE, "op13_strassen_negatives": hard_negatives.ORACLE,
    }
