"""A training-data pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All stages but the last
return the columns of ``documents``. Without labels of both kinds a classifier
rejects nothing.

Defined cases: a null text is the empty text in every stage; a row without an id
is labelled by nothing, a copy of nothing, and stays unless it is rejected;
repeated rows become one at the near-duplicates' stage; very long texts are read
whole and packed in as many pieces as they need; extra columns of ``documents``
are carried up to the packing, which leaves them out; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylake.llm import _common as C
from quarrylake.llm import minhash, packing, quality, toxicity
from quarrylake.plans.ship import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, C.table(spark, sf_dir, "labels", ["doc_id", "quality"])))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, C.table(spark, sf_dir, "labels", ["doc_id", "toxic"])))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return minhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, cut into pieces of token ids and packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Neither the classifiers nor the packing can be written in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one's result written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = given, C.spill(docs, f"pipeline-{name}")
            C.drop(before)
    return docs
