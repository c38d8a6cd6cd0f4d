"""From raw documents to training data: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ironlog.llm import bpe, exact_dedup, minhash_forest, mixture
from ironlog.llm import quality as classifier
from ironlog.llm.common import stored, table
from ironlog.llm.queries import RANKS


#: Similarity of five-word shingle sets, in percent, from which the near_dedup stage links two documents.
NEAR = 85


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject; it learns from ``labels``, held-out rows excepted."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space aside, the one with the smallest doc_id."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked at a similarity of NEAR percent, the document with the smallest doc_id."""
    return minhash_forest.survivors(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each run of a document's words that the mix takes, repeats again."""
    return mixture.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Learned scores, components and permutations are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
