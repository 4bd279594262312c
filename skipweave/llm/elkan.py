"""Clusters around centroids: exact integer k-means whose distances are skipped by Elkan's bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skipweave.llm.common import discard, scratch_table, stored

K, ROUNDS, SEED, DIMS, SCALE = 40, 5, 2, 64, 256
#: Components up to this keep squared distances of some thousand dimensions within 64 bits.
LARGEST = 1 << 25
#: Vectors whose distances are worked out at a time.
CHUNK = 8192


def up(x: np.ndarray) -> np.ndarray:
    """x as a 32-bit float that isn't smaller, with room for the rounding that x itself has had."""
    x = np.nextafter(x, np.inf)
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def down(x: np.ndarray) -> np.ndarray:
    """x as a 32-bit float that isn't larger, likewise."""
    x = np.nextafter(x, -np.inf)
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to the row, or rows, of b."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down."""
    d = np.stack([squared(centroids, c) for c in centroids])
    return down(np.sqrt(d.astype(np.float64)) / 2)


def first_round(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid (of equal ones the smallest number), upper and lower bounds, and how many distances it took: all of them."""
    d = np.stack([squared(x, c) for c in centroids], axis=1)
    a = d.argmin(axis=1)
    root = np.sqrt(d.astype(np.float64))
    return a, up(root[np.arange(len(x)), a]), down(root), d.size


def next_round(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids have moved by at most `moved`, from the bounds of the round before.

    A centroid is skipped where a bound shows that it is farther away, strictly so: what could be as near is measured, so ties go by number as
    they would without bounds. Upper bounds are rounded up and lower ones down.
    """
    a, upper, lower = a.copy(), up(upper.astype(np.float64) + moved[a]), down(np.maximum(lower.astype(np.float64) - moved, 0))
    nearest = np.where(np.eye(len(half), dtype=bool), np.inf, half).min(axis=1)
    todo, n = np.flatnonzero(upper >= nearest[a]), 0
    own = np.zeros(len(x), np.int64)
    own[todo] = squared(x[todo], centroids[a[todo]])
    root = np.sqrt(own[todo].astype(np.float64))
    upper[todo], lower[todo, a[todo]] = up(root), down(root)
    n += len(todo)
    for j in range(len(centroids)):
        some = todo[(a[todo] != j) & (lower[todo, j] <= upper[todo]) & (half[a[todo], j] <= upper[todo])]
        if not len(some):
            continue
        d = squared(x[some], centroids[j])
        n += len(some)
        root = np.sqrt(d.astype(np.float64))
        lower[some, j] = down(root)
        nearer = (d < own[some]) | ((d == own[some]) & (j < a[some]))
        moving = some[nearer]
        a[moving], own[moving], upper[moving] = j, d[nearer], up(root[nearer])
    return a, upper, lower, n


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _round(centroids: np.ndarray, moved: np.ndarray | None):
    half = between(centroids)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                x = _matrix(part.column(1), np.int64)
                if moved is None:
                    a, upper, lower, _ = first_round(x, centroids)
                else:
                    lower = np.frombuffer(b"".join(part.column(4).to_pylist()), np.float32).reshape(len(x), -1)
                    a, upper, lower, _ = next_round(x, part.column(2).to_numpy(), part.column(3).to_numpy(), lower, centroids, moved, half)
                bounds = pa.array([row.tobytes() for row in np.ascontiguousarray(lower, np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a.astype(np.int32)), pa.array(upper), bounds], ["vec_id", "v", "cluster", "upper", "lower"])

    return run


def _measured(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            a = batch.column(2).to_numpy()
            d = squared(_matrix(batch.column(1), np.int64), centroids[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floored multiples of the components, of the vectors with exactly `dims` components, none of them null, infinite or not a number.

    A component of more than LARGEST after scaling is an error, as its distances don't fit 64 bits.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    vec = F.col(vec_col).cast("array<double>")
    kept = vectors.filter((F.size(vec) == dims) & F.forall(vec, finite))
    checked = lambda c: F.when(F.abs(c * scale) <= LARGEST, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large")))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(vec, lambda c: checked(c).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest digests of "seed:vec_id", in that order; of repeated ids the smaller components come first, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in kept.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored mean of each cluster's vectors; empty clusters stay. Sums are made in each task, k rows of a task are shuffled and k reach the driver."""
    dims = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)))
    out = centroids.copy()
    for row in sums.collect():
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(dims)]
    return out


def cluster(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every kept vector, and the final centroids.

    Each round assigns every vector to the nearest centroid, equal ones by the smaller number, and moves the centroids to the floored means; a last
    one assigns only. Vectors of another length or with a null, infinite or undefined component are left out; repeated rows each count; with
    fewer than k vectors there are as many centroids; no vectors give no rows; other columns play no part.

    A round reads the vectors with their upper and k lower bounds and writes them with new ones, in the shared folder; the table before it goes. Nothing is shuffled but sums.
    """
    kept, path = stored(spark, whole_vectors(vectors, id_col, vec_col, dims, scale), "vectors")
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, v array<int>, cluster int, upper float, lower binary"
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    state, moved = kept, None
    for n in range(rounds + 1):
        before = path
        state, path = stored(spark, state.mapInArrow(_round(centroids, moved), schema), "bounds")
        discard(spark, before)
        if n < rounds:
            new = moved_centroids(state, centroids)
            moved = np.nextafter(np.sqrt(squared(new, centroids).astype(np.float64)), np.inf)
            centroids = new
    final = scratch_table(spark, state.mapInArrow(_measured(centroids), f"vec_id {kind}, cluster int, distance long"), "clusters")
    discard(spark, path)
    return final, centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(inertia, "cluster", "left")
    whole = found.agg(F.sum("distance").alias("inertia"))
    per_cluster = named.join(F.broadcast(whole), F.lit(True))  # a row for each of at most K centroids
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
