"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, packing.

Every stage takes the documents that its predecessor kept; all but the last return
the columns of `documents`, the last the pieces of the packed sequences. Near
duplicates share at least 0.8 of their five-word shingles.

Cases, in every stage: a null text counts as empty and a very long one is read whole;
rows with a null doc_id take part but name no group; repeated rows of one doc_id are
judged each by its own text; columns beyond doc_id and text are carried along, whatever
their names; an empty table gives an empty table. The stages say what else they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import op1_packing, op2_minhash, op4_decontaminate, op5_importance, op7_exact_dedup
from riskloom.llm.common import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws. Empty texts weigh 0 and are kept if the
    cut is below; rows that tie with the last one drawn are all kept; repeated rows share their fate."""
    return op5_importance.drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the longest original, then the smallest doc_id.
    All empty texts are one group; of repeated rows one stays."""
    return op7_exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the smallest doc_id. Empty texts are near to
    nothing and stay; of repeated rows one stays."""
    return op2_minhash.one_of_each(docs, size=5, share=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without benchmark passages; empty texts and items match nothing, and repeated
    rows are judged alike."""
    return op4_decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; an empty text is its end id alone, repeated rows are packed each."""
    return op1_packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", pack)]

#: SQL expresses neither the models nor the tokens; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
