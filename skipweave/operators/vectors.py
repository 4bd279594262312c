"""Vector search by an inverted file: vectors in lists around centroids, of which a query reads the nearest, with exact similarities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that centroids are fitted to at most, the smallest by hash; every vector is put in a list.
SAMPLE = 20_000
#: The most lists, and rounds of the fit.
LISTS, ROUNDS = 1024, 8
#: Of the sample's nearest neighbours of so many of its vectors, this share has to lie in the lists that a query reads.
TRIED, FOUND = 256, 0.97


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit_centroids(vectors: DataFrame, id_col: str, vector_col: str, lists: int | None = None, sample: int = SAMPLE, k: int = 10) -> tuple[np.ndarray, int]:
    """Directions around which vectors lie, some sqrt(n) of them unless lists is given, and how many lists a query has to read.

    Both come from at most `sample` vectors, on the driver. Neighbours within a sample lie farther apart than those among all vectors, so the lists that hold FOUND
    of them hold more of the true ones. Vectors in clear groups need few lists; where there are none, a query has to read most.
    """
    n = vectors.count()
    some = vectors.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample).select(vector_col).collect()
    if not some:
        return np.zeros((0, 0)), 0
    x = _units([r[0] for r in some])
    size = min(lists or min(LISTS, max(1, math.isqrt(n))), len(x))
    centroids = x[np.random.default_rng(0).choice(len(x), size, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    own, tried = (x @ centroids.T).argmax(axis=1), x[:TRIED]
    near = np.argsort(-(tried @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(tried @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
    needed = np.sort(np.take_along_axis(place, own[near], axis=1), axis=None)
    return centroids, int(needed[min(len(needed) - 1, math.ceil(FOUND * len(needed)) - 1)]) + 1


def _lists(centroids: np.ndarray, vector_col: str, read: int):
    def run(frames):
        for pdf in frames:
            if len(pdf):
                nearness = _units(pdf[vector_col]) @ centroids.T
                near = nearness.argmax(axis=1)[:, None] if read == 1 else np.argsort(-nearness, axis=1, kind="stable")[:, :read]
                yield pdf.assign(lists=list(near.astype(np.int32)))

    return run


def in_lists(vectors: DataFrame, centroids: np.ndarray, vector_col: str, read: int = 1) -> DataFrame:
    """vectors with `lists`, the numbers of their nearest `read` centroids. Centroids go with the task: LISTS of them at most."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return vectors.mapInPandas(_lists(centroids, vector_col, read), StructType([*vectors.schema.fields, StructField("lists", ArrayType(IntegerType()))]))


def build_index(vectors: DataFrame, folder: str, id_col: str = "node_id", vector_col: str = "vector", lists: int | None = None) -> tuple[np.ndarray, int]:
    """Write every vector into its list, sorted by lists in ranges that the ids cut too; returns the centroids and how many lists a query has to read. All vectors have one length and no null among their components."""
    centroids, read = fit_centroids(vectors, id_col, vector_col, lists)
    placed = in_lists(vectors.select(id_col, vector_col), centroids, vector_col).select(id_col, vector_col, F.get("lists", F.lit(0)).alias("list"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "list", id_col).sortWithinPartitions("list", id_col).write.mode("overwrite").parquet(f"{folder}/lists")
    return centroids, read


def ranked(scored: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_col))
    return scored.withColumn("nth", rn).filter(F.col("nth") <= k)


def _dense(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each vector, -1 for a null; components, padded with zeros; norms)."""
    size = np.array([-1 if v is None else len(v) for v in vectors], np.int64)
    x = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    for i, v in enumerate(vectors):
        if size[i] > 0:
            x[i, : size[i]] = np.asarray(v, np.float64)
    return size, x, np.sqrt(_in_order(x, x))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed component by component as `cosine` does, so that equal vectors have equal ones wherever they lie."""
    out = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for k in range(x.shape[1]):
            out += x[:, k] * y[:, k]
    return out


#: Similarities of a tile, those measured exactly at a time, what rounding may make of one, and vectors and queries of a block.
TILE, SIDE, SLACK, HELD, ASKING = 1 << 22, 1 << 16, 1e-9, 1 << 14, 1 << 12


def _best(k: int, id_col: str, vector_col: str):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of a block of vectors each query's k best: matrix products say which may be among them, and those are measured exactly."""
        names, out = ["query_id", id_col, "similarity", "nan"], []
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        ids, held, asked = left[id_col].to_numpy(), left[vector_col].tolist(), right["query"].tolist()
        order = np.argsort(ids, kind="stable")
        (size, x, norm), (size_q, q, norm_q) = _dense(held), _dense(asked)
        width = max(x.shape[1], q.shape[1])
        x, q = (np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in (x, q))
        with np.errstate(all="ignore"):
            odd, odd_q = (~np.isfinite(n) | ((n > 0) & ((n < 1e-100) | (n > 1e100))) for n in (norm, norm_q))
            unit, unit_q = (np.where(((n > 0) & ~o)[:, None], t / n[:, None], 0) for t, n, o in ((x, norm, odd), (q, norm_q, odd_q)))
        step, top = max(1, TILE // len(x)), min(k, len(x))
        for i in range(0, len(q), step):
            near = unit_q[i : i + step] @ unit.T
            near[size_q[i : i + step, None] != size[None]] = 0
            near[(odd[None] | odd_q[i : i + step, None]) & (size_q[i : i + step, None] == size[None]) & (size[None] >= 0)] = 2  # measured in any case
            usual = np.where(near > 1, -2, near)
            least = np.partition(usual, len(x) - top, axis=1)[:, len(x) - top]
            row, col = np.nonzero(near >= least[:, None] - SLACK)
            same = size_q[row + i] == size[col]
            dots = np.concatenate([_in_order(x[col[j : j + SIDE]], q[row[j : j + SIDE] + i]) for j in range(0, len(row), SIDE)])
            with np.errstate(all="ignore"):
                n = norm_q[row + i] * norm[col]
                value = np.where(same & (size[col] >= 0) & ((n > 0) | np.isnan(n)), dots / n, 0.0)
            rank = np.where(np.isnan(value), -np.inf, -value)
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            best = np.lexsort((place[col], rank, row))
            nth = np.arange(len(best)) - np.searchsorted(row[best], row[best])
            best = best[nth < k]
            out.append(pd.DataFrame({"query_id": right["query_id"].to_numpy()[row[best] + i], id_col: ids[col[best]], "similarity": value[best], "nan": np.isnan(value[best])}))
        return pd.concat(out, ignore_index=True)

    return run


def _meet(held: DataFrame, asked: DataFrame, keys: list[str], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k best of each query among the vectors that it shares keys with, and then of all these."""
    types = dict(held.dtypes), dict(asked.dtypes)
    whole = lambda c: F.when(~F.exists(c, lambda v: v.isNull()), F.col(c))  # noqa: E731  a vector with a null component has similarity 0, as a null has
    held, asked = held.withColumn(vector_col, whole(vector_col)), asked.withColumn("query", whole("query"))
    schema = f"query_id {types[1]['query_id']}, `{id_col}` {types[0][id_col]}, similarity double, nan boolean"
    scored = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_best(k, id_col, vector_col), schema)
    scored = scored.select("query_id", id_col, F.when(F.col("nan"), float("nan")).otherwise(F.col("similarity")).alias("similarity"))  # pandas has a null for it
    return ranked(scored, "query_id", id_col, k)


def _parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def search(queries: DataFrame, folder: str, centroids: np.ndarray, read: int, k: int = 10, id_col: str = "node_id", vector_col: str = "vector") -> DataFrame:
    """query_id, id, similarity, nth: the k most similar vectors of the lists that each query (query_id, query) reads.

    Lists are cut by ids into parts of some HELD vectors. A part meets the queries that read its list, ASKING at a time, in matrix products; similarities are exact cosines.
    """
    lists = queries.sparkSession.read.parquet(f"{folder}/lists")
    longest = lists.groupBy("list").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    cuts, turns = _parts(longest, HELD), _parts(queries.count(), ASKING)
    number = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = in_lists(queries, centroids, "query", read).select("query_id", "query", F.explode("lists").alias("list"), number("query_id", turns).alias("turn")).withColumn("part", every(cuts))
    held = lists.select(id_col, vector_col, "list", number(id_col, cuts).alias("part")).withColumn("turn", every(turns))
    return _meet(held, asked, ["list", "part", "turn"], k, id_col, vector_col)


def search_all(queries: DataFrame, vectors: DataFrame, k: int = 10, parts: int | None = None, id_col: str = "node_id", vector_col: str = "vector") -> DataFrame:
    """The same from every vector: each part of the vectors meets all queries, ASKING at a time, in matrix products. It is what the index is measured against."""
    cuts, turns = parts or max(16, _parts(vectors.count(), HELD)), _parts(queries.count(), ASKING)
    number = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "query", number("query_id", turns).alias("turn")).withColumn("part", every(cuts))
    held = vectors.select(id_col, vector_col, number(id_col, cuts).alias("part")).withColumn("turn", every(turns))
    return _meet(held, asked, ["part", "turn"], k, id_col, vector_col)
