"""From raw documents to packed token ids: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epistride.llm import decontaminate, mixing, nearcopies, packing, queries, simhash, toxicity
from epistride.session import stored


def _not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model learns from the labelled documents."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def _one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, of every component of texts whose 5-word shingles are alike to 0.8.

    SimHash fingerprints under Golay keys propose, as in op7, and MinHash bands what lies beyond their four bits;
    the whole sets decide.
    """
    return simhash.keep_one(docs, near=nearcopies.near_copies)


def _not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as the mix takes it, the last time in part."""
    plan = mixing.mix_plan(docs, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_MOST)
    return mixing.mixed_documents(docs, plan)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into rows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", _not_toxic),
    ("near-dedup", _one_of_each),
    ("decontamination", _not_in_benchmark),
    ("mixing", _mixed),
    ("packing", _packed),
]

#: The classifier and the packing are not SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
