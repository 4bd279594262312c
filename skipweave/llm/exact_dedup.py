"""Exact deduplication with a split of heavy hitters."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipweave.llm.common import ROW, WS, full_text, marked, numbered, placed, scratch_table

#: Counters of a Misra-Gries summary, and the most winners that are broadcast.
CAPACITY = 1024


def misra_gries(counts: Counter, capacity: int) -> Counter:
    """Cut a summary back to capacity: the (capacity+1)-th count is taken off all, what reaches zero goes.

    Summaries stay mergeable: an item with more than n / (capacity + 1) of n occurrences is never lost.
    """
    if len(counts) <= capacity:
        return counts
    cut = sorted(counts.values(), reverse=True)[capacity]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summaries(capacity: int):
    def run(batches):
        summary: Counter = Counter()
        for batch in batches:
            summary.update(batch.column(0).to_pylist())
            summary = misra_gries(summary, capacity)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(summary.keys()), pa.binary()), pa.array(list(summary.values()), pa.int64())], ["digest", "estimate"]
        )

    return run


def text_digest(df: DataFrame, column: str = "text"):
    return F.unhex(F.sha2(F.regexp_replace(full_text(df, column), WS, " ").cast("binary"), 256))


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, row_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and the row's number.

    Texts are equal when identical after each run of ASCII white space becomes one space; null is the empty
    text. Of equal texts the smallest id stays; null ids come last, repeated rows with one id keep the first.
    row_col is a number of the rows that every scan gives again (see placed); without it they are numbered here. An empty table gives no rows; other columns play no part.

    Only digests leave the scan. Misra-Gries summaries of each partition are summed, the largest are counted
    exactly, and these winners (at most capacity rows) are broadcast, so the rows of hot groups never move. Summing loses at most
    1 / capacity of the rows of a digest and the cut after it as much again, so what is left has no digest with more than 2 / capacity of them; it
    takes one ordinary shuffle.
    """
    narrow = docs.select(id_col, text_col, F.col(row_col).alias(ROW)) if row_col else numbered(docs.select(id_col, text_col))
    narrow = narrow.select(F.col(id_col).alias("doc_id"), ROW, text_digest(narrow, text_col).alias("digest"))
    stored = scratch_table(spark, narrow, "digests")

    summaries = stored.select("digest").mapInArrow(_summaries(capacity), "digest binary, estimate long")
    frequent = summaries.groupBy("digest").agg(F.sum("estimate").alias("estimate")).orderBy(F.desc("estimate"), "digest").limit(capacity)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    winners = (
        stored.join(F.broadcast(frequent.select("digest")), "digest")
        .groupBy("digest")
        .agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    winners = scratch_table(spark, winners, "winners")

    heavy = stored.join(F.broadcast(winners), "digest")
    light = stored.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    light = light.withColumn("first", F.min(first).over(group)).withColumn("group_size", F.count("*").over(group))
    return (heavy.select(*light.columns).unionByName(light)).select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col(ROW) == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        ROW,
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(spark, docs).drop(ROW)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops, with the columns of docs, whatever their names; docs are neither written nor shuffled: bits for the dropped rows meet them where they are read."""
    docs, row = placed(spark, docs)
    dropped = exact_dedup(spark, docs, row_col=row).filter("NOT kept").select(ROW)
    return marked(docs, row, dropped, keep=False).drop(row)
