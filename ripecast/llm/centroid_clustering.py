"""Lloyd's clustering in integers, with centroids filtered by PCA-rotated coordinates.

Components become integers, floor(256 x). A rotation, the eigenvectors of the integer vectors' covariance (whose sums Spark
adds up), is fitted once; every vector is stored with its LEADING rotated coordinates and the norm of
the rest. For a vector and a centroid, the distance of the leading coordinates squared plus the squared difference of the rest
norms is never more than their squared distance. So the centroid with the least bound is measured in integers, and of the others only
those whose bound does not exceed that measure; ties go to the smaller number. The bounds are floating point and get a slack
for rounding; what decides is computed in 64-bit integers.

Each round is one pass over the stored vectors; a task sends one row of sums per cluster at most, whatever a cluster's size.
The driver holds the centroids (clusters x dimensions numbers) and a covariance of dimensions squared.

Defined results: a vector is kept if it has exactly `dimensions` components, none null or non-finite, and none beyond
+-LARGEST, where a squared distance would leave 64 bits; other rows are left out. Repeated rows are vectors like any others; equal
starting hashes go by vec_id and components, a null id hashes like an empty one. Fewer kept vectors than
clusters give fewer centroids, none give no rows. An empty cluster keeps its centroid. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.llm import text
from ripecast.llm.exchange import release
from ripecast.sources.files import materialize

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
LEADING = 12
LARGEST = 2.0 ** 27 / SCALE
BLOCK_ROWS = 8192

PACKED = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("whole", T.BinaryType()),
    T.StructField("leading", T.BinaryType()), T.StructField("rest", T.DoubleType())])
SUMS = T.StructType([
    T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())),
    T.StructField("measured", T.LongType())])
PLACED = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, whole): integer components of the vectors that can be clustered."""
    text.require(vectors, "vec_id", "embedding")
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("bigint")).alias("whole"))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of seed and id, a bounded number."""
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = whole.orderBy(F.sha2(ident.cast("binary"), 256), "vec_id", "whole").limit(clusters).collect()
    return np.array([r.whole for r in rows], np.int64)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def covariance(whole: DataFrame, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance; one row of dimensions x (dimensions + 1) sums per task, added by Spark."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros((dimensions, dimensions))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("whole")).astype(np.float64)
                n, total, squares = n + len(x), total + x.sum(0), squares + x.T @ x
        sums = np.concatenate([[n], total, squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["at", "v"])

    rows = whole.select("whole").mapInArrow(add_up, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(1 + dimensions + dimensions**2)
    for r in rows:
        sums[r["at"]] = r["v"]
    n = max(sums[0], 1.0)
    mean = sums[1:dimensions + 1] / n
    return mean, sums[dimensions + 1:].reshape(dimensions, dimensions) / n - np.outer(mean, mean)


@dataclass(frozen=True)
class Rotation:
    """Leading principal directions around a mean. Any orthonormal directions give right bounds, these give tight ones."""
    mean: np.ndarray
    directions: np.ndarray  # dimensions x leading

    def split(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates, and the norm of what they leave out."""
        centred = whole - self.mean
        leading = centred @ self.directions
        rest = centred - leading @ self.directions.T
        return leading, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def rotation(whole: DataFrame, dimensions: int = DIMENSIONS, leading: int = LEADING) -> Rotation:
    mean, cov = covariance(whole, dimensions)
    values, vectors = np.linalg.eigh(cov)
    return Rotation(mean, np.ascontiguousarray(vectors[:, np.argsort(-values)[:leading]]))


def packed(whole: DataFrame, turn: Rotation) -> DataFrame:
    """Vectors with their rotated coordinates, as bytes."""
    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("whole"))
            near, rest = turn.split(x.astype(np.float64))
            rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield text.batch(PACKED, vec_id=b.column("vec_id"), whole=rows(x), leading=rows(near), rest=rest)

    return whole.mapInArrow(pack, PACKED)


def nearest(whole: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many distances were measured."""
    c_near, c_rest = turn.split(centroids.astype(np.float64))
    size = np.einsum("ij,ij->i", leading, leading)
    c_size = np.einsum("ij,ij->i", c_near, c_near)
    flat = np.maximum(size[:, None] - 2 * (leading @ c_near.T) + c_size, 0.0)
    bound = flat + (rest[:, None] - c_rest) ** 2
    # Far above the rounding error of the bound, far below what would let useless candidates in.
    slack = 1e-9 * (size + rest ** 2)[:, None] + 1e-9 * (c_size + c_rest ** 2) + 1e-3
    bound -= slack
    rows = np.arange(len(whole))
    guess = bound.argmin(1)
    best = np.square(whole - centroids[guess]).sum(1)
    survivors = bound <= best[:, None]
    survivors[rows, guess] = False
    own = guess.copy()
    at, which = np.nonzero(survivors)
    measured = len(whole) + len(at)
    if len(at):
        far = np.square(whole[at] - centroids[which]).sum(1)
        all_at, all_which = np.concatenate([rows, at]), np.concatenate([guess, which])
        all_far = np.concatenate([best, far])
        order = np.lexsort((all_which, all_far, all_at))
        first = order[np.concatenate([[True], np.diff(all_at[order]) > 0])]
        own, best = all_which[first], all_far[first]
    return own, best, measured


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, turn: Rotation):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            whole = np.frombuffer(b"".join(part.column("whole").to_pylist()), np.int64).reshape(part.num_rows, -1)
            leading = np.frombuffer(b"".join(part.column("leading").to_pylist()), np.float64).reshape(part.num_rows, -1)
            yield part, whole, *nearest(whole, leading, part.column("rest").to_numpy(zero_copy_only=False), centroids, turn)
    release()


def moved(vectors: DataFrame, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, int]:
    """Centroids after one round, and the number of distances it measured."""
    def add_up(batches):
        n = np.zeros(len(centroids), np.int64)
        total, seen = np.zeros(centroids.shape, np.int64), 0
        for _, whole, own, _, measured in _assigned(batches, centroids, turn):
            n += np.bincount(own, minlength=len(centroids))
            np.add.at(total, own, whole)
            seen += measured
        used = np.flatnonzero(n)
        yield text.batch(SUMS, cluster=used.astype(np.int32), n=n[used], sums=list(total[used]),
                         measured=np.where(np.arange(len(used)) == 0, seen, 0))

    sums = vectors.mapInArrow(add_up, SUMS)
    # Decimal sums can't overflow however many vectors there are.
    exact = sums.select("cluster", "n", "measured", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("v"), F.sum("measured").alias("measured"))
    out, seen = centroids.copy(), 0
    for r in exact.collect():  # clusters x dimensions rows
        out[r["cluster"], r["at"]] = int(r["v"]) // r["n"]
        seen += r["measured"] if r["at"] == 0 else 0
    return out, seen


def placed(vectors: DataFrame, centroids: np.ndarray, turn: Rotation) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def place(batches):
        for part, _, own, far, _ in _assigned(batches, centroids, turn):
            yield text.batch(PLACED, vec_id=part.column("vec_id"), cluster=own.astype(np.int32), distance=far)

    return vectors.mapInArrow(place, PLACED)


def _sum(distance: Column) -> Column:
    return F.sum(distance.cast("decimal(20,0)"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, leading: int = LEADING,
            seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    whole = kept(vectors, dimensions)
    centroids = first_centroids(whole, clusters, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
    turn = rotation(whole, dimensions, leading)
    stored = materialize(packed(whole, turn), "rotated-vectors")
    for _ in range(rounds):
        centroids, _ = moved(stored, centroids, turn)
    rows = materialize(placed(stored, centroids, turn), "clusters")
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())],
        "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(_sum(F.col("distance")).alias("cluster_inertia"))
    whole_sum = per.agg(F.sum("cluster_inertia").alias("inertia"))
    # A row per cluster.
    about = per.join(digests, "cluster").crossJoin(whole_sum).select(
        "cluster", F.col("cluster_inertia").cast("bigint").alias("cluster_inertia"), F.col("inertia").cast("bigint").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
