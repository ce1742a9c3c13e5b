"""A training-data pipeline over the documents: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of the documents. A stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import decontaminate, near_dedup, packing, pii, quality
from ticketloom.llm.common import scratch_path, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents, and boilerplate lines from the others."""
    return quality.clean(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each class of near duplicates."""
    return near_dedup.deduplicated(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put format-preserving pseudonyms in the place of personal data."""
    return pii.pseudonymised(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' token ids into training sequences, one row per piece."""
    return packing.pack_digest(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("decontamination", benchmark_decontamination),
    ("pii", pii_pseudonyms),
    ("packing", sequence_packing),
]

#: SQL cannot tokenize, and has no keyed permutation; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), scratch_path(spark, f"stage-{name}"))
    return docs
