"""Corpus pipeline: from raw documents to clean, unique, decontaminated texts and their tokens.

Every stage reads all documents that the stage before it kept, as a table in the shared folder. All but
the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fintally.llm import common, decontaminate, exact_dedup, piece_lattice, piece_model, quality_mil, simhash_bktree

#: Words in the dictionary that the last stage broadcasts: the driver builds it (16 MB), after all other stages.
DICTIONARY = 1 << 17


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_mil.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts: the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return simhash_bktree.drop_near_duplicates(docs, shingle=3, radius=3)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words, tokens and token digest of every document that is left, and whether its tokens decode to it."""
    return piece_lattice.token_digests(docs, piece_model.model_bytes(), dictionary=DICTIONARY)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near),
          ("benchmark decontamination", benchmark), ("SentencePiece encoding and decoding", tokens)]

#: Hashes, learned weights and edit distances have no SQL: run() is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"stage{i}")
    return docs
