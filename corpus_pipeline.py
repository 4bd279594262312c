"""The corpus pipeline: quality rules, language, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the docs of the next one. All but
the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skipweave.llm import exact_dedup, language, packing, quality_rules, simhash
from skipweave.session import scratch_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(spark, docs, sf_dir)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(spark, docs, sf_dir)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(spark, docs, sf_dir)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("best_fit_packing", packed),
]
#: Trained weights decide the second stage and a heuristic the last, so SQL can't give these rows; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table of sf_dir.

    Null and empty texts fail the quality rules; null ids are kept, and of equal texts the smallest id that is not null stays; of repeated rows the first
    stays. An empty table gives no rows. Extra columns pass through all stages but the last, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
