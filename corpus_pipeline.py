"""A training corpus from raw documents: quality classifier, exact dedup, near dedup, mixing, packing.

Defined results: a null text counts as empty in every stage; a null id is kept like any other and never is the one that a group keeps while
another has an id; rows that repeat an id are documents of their own, rows equal in id and text are copies; a null source is a source of its own, last in
order; an empty table gives an empty result; columns beside doc_id, text, source and n_chars go along whatever their names, up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, mixture, packing, qda, simhash
from lectern.llm._common import stage, unstage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles at a similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their weights."""
    return mixture.repeat_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.packed_pieces(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packed)]

#: The classifier and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
        unstage(*old)
        old = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
