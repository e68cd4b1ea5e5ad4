"""The corpus pipeline: quality rules, quality classifier, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``; the last returns the packed pieces. Nulls, empty
and very long texts, repeated rows, empty tables and further columns have the results that each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinelake.llm import common
from kinelake.llm.entry_queries import tokenizer_path
from kinelake.llm.exact_dedup import drop_exact_copies
from kinelake.llm.near_dedup import drop_near_copies
from kinelake.llm.packing import pack_documents
from kinelake.llm.quality_classifier import drop_rejected
from kinelake.llm.quality_rules import drop_low_quality


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the label model reject go."""
    return drop_low_quality(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.3 go. Learns from the labelled rows of ``docs``: the documents table itself may be gone."""
    return drop_rejected(docs, docs, common.table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_exact_copies(docs, keep="max")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays."""
    return drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path(), capacity=4096, end=1)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The label model, the classifier and the packing plan have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for place, (_, stage) in enumerate(STAGES):
        docs = scratch.put(f"stage{place}", stage(spark, docs, sf_dir))
        if place:
            scratch.drop(f"stage{place - 1}")
    return docs
