"""Keyword search by an index of trigrams: which texts may hold a query, and a check of those alone."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skipweave.functions.text import contains_ascii
from skipweave.session import scratch_table

#: Trigrams of a query that are looked up, the rarest first.
ASKED = 4
#: Characters whose trigrams are listed at a time.
STEP = 1 << 21


def _texts(columns: list[np.ndarray]):
    """Texts of all columns, some at a time: (row of each, code points of all, length of each); A-Z as a-z, nulls left out."""
    rows, texts, held = [], [], 0
    for i in range(len(columns[0])):
        for c in columns:
            if c[i]:
                rows.append(i)
                texts.append(c[i])
                held += len(c[i])
        if held > STEP or i == len(columns[0]) - 1:
            if texts:
                points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
                yield np.array(rows), np.where((points >= 65) & (points <= 90), points + 32, points), np.array([len(t) for t in texts])
            rows, texts, held = [], [], 0


def _spelled(code: int) -> str:
    return "".join(chr((code >> k & 0x1FFFFF) - 1) for k in (42, 21, 0) if code >> k & 0x1FFFFF)


def _post(keys: list[str], columns: list[str]):
    def run(frames):
        """Each row's distinct trigrams: three code points plus one in a number of 63 bits, so a shorter text's has zeros before."""
        for pdf in frames:
            for row, points, size in _texts([pdf[c].to_numpy() for c in columns]):
                points, ends = points + 1, np.cumsum(size)
                text = np.repeat(np.arange(len(size)), size)
                last = np.arange(len(points)) - np.repeat(ends - size, size)  # the place of each trigram's last character
                code = points.copy()
                code[1:] |= np.where(last[1:] >= 1, points[:-1], 0) << 21
                code[2:] |= np.where(last[2:] >= 2, points[:-2], 0) << 42
                whole = (last >= 2) | ((np.repeat(size, size) < 3) & (last == np.repeat(size, size) - 1))
                code, of = code[whole], row[text[whole]]
                order = np.lexsort((code, of))
                code, of = code[order], of[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
                code, of = code[new], of[new]
                values, which = np.unique(code, return_inverse=True)
                names = np.array([_spelled(int(v)) for v in values], object)
                for i in range(0, len(of), 1 << 19):
                    yield pdf[keys].iloc[of[i : i + (1 << 19)]].reset_index(drop=True).assign(gram=names[which[i : i + (1 << 19)]])

    return run


def build_index(rows: DataFrame, keys: list[str], columns: list[str], folder: str) -> str:
    """Write the postings of rows, one for each distinct trigram of a row's columns, and how often each trigram is posted; returns folder.

    Postings are sorted by trigram in ranges, which a frequent trigram's keys cut too, so a lookup reads the row groups of its trigrams alone.
    """
    spark = rows.sparkSession
    named = [f"__c{i}" for i in range(len(columns))]
    texts = rows.select(*keys, *(F.col(c).alias(n) for c, n in zip(columns, named, strict=True)))
    posted = texts.mapInPandas(_post(keys, named), StructType([*rows.select(*keys).schema.fields, StructField("gram", StringType())]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = scratch_table(spark, posted, "grams")  # ranges are sampled from it, so texts are cut up once
    posted.repartitionByRange(parts, "gram", *keys).sortWithinPartitions("gram", *keys).write.mode("overwrite").parquet(f"{folder}/postings")
    counts = spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{folder}/counts")
    return folder


def asked_grams(spark: SparkSession, folder: str, query: str, most: int = ASKED) -> list[str] | None:
    """The rarest trigrams of a query that a text has to have all of; nothing where one isn't posted. None for a query of under three letters."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in query)
    wanted = sorted({lower[i : i + 3] for i in range(len(lower) - 2)})
    if not wanted:
        return None
    found = spark.read.parquet(f"{folder}/counts").filter(F.col("gram").isin(wanted)).orderBy("n", "gram").collect()  # at most the query's own trigrams
    return [r.gram for r in found[:most]] if len(found) == len(wanted) else []


def candidates(spark: SparkSession, folder: str, query: str, keys: list[str], most: int = ASKED) -> DataFrame:
    """Keys of the rows that may hold the query: all that do, and few others."""
    posted, grams = spark.read.parquet(f"{folder}/postings"), asked_grams(spark, folder, query, most)
    if grams is None:  # one or two letters stand in some trigram, or in a text as short
        return posted.filter(contains_ascii(F.col("gram"), query)).select(*keys).distinct()
    held = posted.filter(F.col("gram").isin(grams)) if grams else posted.filter("false")
    return held.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(*keys)


def keyword_search(rows: DataFrame, folder: str, query: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of which a column holds the query, as a scan finds them: candidates of the index, checked. Keys must not be null; an empty query finds every row with a text."""
    held = reduce(Column.__or__, (contains_ascii(F.col(c), query) for c in columns))
    if not query:
        return rows.filter(held)
    return rows.join(candidates(rows.sparkSession, folder, query, keys), keys, "left_semi").filter(held)
