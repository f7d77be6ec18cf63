"""Corpus preparation: quality rules, quality classifier, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitweave.llm import near_dedup, packing, quality_rules, weak_labels
from visitweave.llm.common import table
from visitweave.llm.queries import ORACLES, QUERIES
from visitweave.storage import fresh_path, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier takes for good."""
    return weak_labels.keep(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 of their five-word shingles in common."""
    return near_dedup.keep(docs, link=80, width=5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_stage), ("quality classifier", classifier_stage),
          ("near duplicates", dedup_stage), ("packing", packing_stage)]

#: The classifier is fitted by iteration and packing is a greedy walk: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored as Parquet and read again.

    What a stage stored on its way is removed when its result is there.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs


ALL_QUERIES = {**QUERIES, "pipeline": run}
ALL_ORACLES = {**ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
