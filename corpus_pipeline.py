"""A corpus pipeline of five stages, from documents to packed token sequences.

Each stage takes what the one before it kept, written as Parquet and read again. All
stages but the last give rows of their input with all its columns, whatever their
names; a repeated row gets one decision; an empty table gives an empty one; a text of
any length is judged whole. What each does with nulls and ties is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import common, decontam, packing, quality, simhash, toxicity
from tesserine.llm.tokens import default_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their group's centre. Null and
    empty texts fail the rules and go; a null lang or source is a group of its own."""
    return quality.filtered(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under their language's threshold; the model is trained on labelled
    rows of what this stage is given. A null text is judged as one without words, a
    null lang by the threshold of all; null ids have no labels, of conflicting ones
    the toxic counts."""
    return toxicity.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id (null
    last), of several texts under it that with the least hash, of its repeats one.
    Null, empty and blank texts are one group."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A null text has none and stays."""
    return decontam.filtered(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of one length. A null or empty text is its
    end id; null and repeated doc_ids are packed a row at a time."""
    return packing.pack(docs, default_path())


STAGES = [("quality", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: SQL can express none of the trained, iterative or tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
