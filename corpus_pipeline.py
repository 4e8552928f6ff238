"""Corpus pipeline: filter, deduplicate, decontaminate and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelog.llm import decontamination, line_dedup, near_documents, packing, quality_rules
from tablelog.llm.common import stored, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, native=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more."""
    found = near_documents.near_duplicates(docs)
    return without(docs, stored(found.filter("doc_id <> component_id").select("doc_id"), "pipeline-copies"), "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage, however long they are.

    The share that makes op4's rows contaminated is for reports; training data
    must not hold a known leak, and a long document hides it from a share.
    """
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stored(found.filter("n_hit > 0").select("doc_id"), "pipeline-leaks"), "doc_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.op1_packing(spark, sf_dir, docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokens and packing are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
