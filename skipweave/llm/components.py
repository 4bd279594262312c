"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipweave.llm.common import discard, stored


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of links (a, b), where root is the smallest node of the component.

    Large stars and small stars in turn: each node sends its larger neighbours, then its smaller ones, to the smallest node it knows,
    until every link points to a root. A round is two shuffles of at most the number of links; each is written to the shared folder, so
    the lineage stays short, and takes the place of the one before. The smallest neighbour is found by an aggregate, so a node with many links is never gathered.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    (edges, path), before = stored(spark, edges, "links"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large, middle = stored(spark, large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges, after = stored(spark, small, "small")
        for old in (path, middle):
            discard(spark, old)
        path = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
