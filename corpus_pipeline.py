"""The corpus pipeline: quality classifier, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns
as Parquet in the shared folder and reads it again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import mixing, near_dedup, packing, quality
from tracelake.llm.common import materialise, read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts; it learns from the table of labels."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; documents repeat where a source is used more than once."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", good_quality), ("near-duplicates", one_of_each), ("source mixing", mixed), ("packing", packed)]

#: SQL can express neither the model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
