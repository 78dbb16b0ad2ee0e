"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns
of documents. Columns that documents has besides are carried through the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import exact_dedup, mixing, packing, simhash, toxicity
from sieveline.llm.common import durable, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the lexicon is learned from the labels."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts whose sets of shingles are linked."""
    return simhash.keep_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that meet the source, language and topic marginals."""
    return mixing.sample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, every window in the proportions of the sources."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("simhash", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: SQL can express neither the trained score nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
