"""k-means on integers whose assignments come from Orchard's search.

Every centroid holds the list of all centroids sorted by their distance from it. The search for a vector's centroid begins at the most central one and walks the current centroid's list; a closer centroid found there becomes the current one and its list starts over; centroids seen once are marked and not measured again. It ends where the list's next entry is strictly beyond twice the current distance: whatever follows is farther from the vector, by the triangle inequality, and cannot even tie.

A round is one scan of the vectors: each task walks its Arrow batches in lockstep and returns sums and counts of its clusters, at most k rows of exact numbers, which Spark adds up. Only centroids (k x dimension integers) reach the driver and the tasks, so what moves doesn't grow with the table; no vector is shuffled, and a lost executor costs its tasks.

All arithmetic is exact: components are floor(scale * x) as integers, distances int64, sums decimals.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; nor do those with a component of 2**27 or more in size after scaling, whose squared distances would not fit a long. Rows with equal identifiers are vectors of their own; a null identifier is kept and starts a centroid only after all others. Equal hashes are ordered by the vectors' components. Fewer vectors than k give fewer centroids; equal starting vectors give equal centroids of which the first takes all. Sums beyond a long are null. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare, stored

#: Components of a vector, centroids, rounds of averaging, and the factor before rounding down.
DIMENSION, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Text before an identifier whose hash orders the vectors that start as centroids.
SEED = "2:"
#: Components of this size would let a squared distance pass 63 bits.
BEYOND = 1 << 27
#: Vectors that walk in lockstep.
STRIP = 4096


def whole_numbers(vectors: DataFrame, dimension: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<int>): the vectors that take part."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    within = F.forall(vector_col, lambda x: F.coalesce(F.abs(scaled(x)) < F.lit(float(BEYOND - 1)), F.lit(False)))  # NaN is beyond all numbers
    return vectors.where((F.size(vector_col) == dimension) & within).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(scaled(x)).cast("int")).alias("v"))


def first_centroids(numbers: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of their identifier."""
    rank = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["v"] for r in numbers.select(rank.alias("rank"), "v").orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).collect()], np.int64)


class Orchard:
    """Sorted neighbour lists of the centroids and the search along them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)
        self.start = int(apart.astype(float).sum(axis=1).argmin())

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid, ties to the smaller number, and the squared distance."""
        n, k = len(x), len(self.centroids)
        at = np.full(n, self.start)  # whose list is walked
        near = self._distances(x, np.arange(n), at)
        best = at.copy()
        seen = np.zeros((n, k), bool)
        seen[:, self.start] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            here, step = at[walking], place[walking]
            # strictly beyond twice the distance; halves compare without overflow
            on = self.apart[here, step] / 4 <= near[walking] * (1 + 1e-12)
            walking, here, step = walking[on], here[on], step[on]
            place[walking] = step + 1
            other = self.lists[here, step]
            fresh = ~seen[walking, other]
            rows, other = walking[fresh], other[fresh]
            seen[rows, other] = True
            found = self._distances(x, rows, other)
            closer, level = found < near[rows], (found == near[rows]) & (other < best[rows])
            best[rows[level]] = other[level]
            jumps, to = rows[closer], other[closer]
            near[jumps], best[jumps], at[jumps], place[jumps] = found[closer], to, to, 0
            walking = walking[place[walking] < k]
        return best, near

    def _distances(self, x: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        apart = x[rows] - self.centroids[which]
        return np.einsum("ij,ij->i", apart, apart)


def batches_of(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, STRIP):
            part = batch.slice(low, STRIP)
            yield part["vec_id"], part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def averaged(numbers: DataFrame, centroids: np.ndarray, dimension: int) -> np.ndarray:
    """One round: centroids moved to the exact floor of their vectors' mean; empty ones stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        sums, counts = [[0] * dimension for _ in range(k)], [0] * k
        for _, x in batches_of(batches, dimension):
            of, _ = search.search(x)
            part = np.zeros((k, dimension), np.int64)
            np.add.at(part, of, x)
            for i, n in enumerate(np.bincount(of, minlength=k).tolist()):
                if n:
                    counts[i] += n
                    sums[i] = [a + b for a, b in zip(sums[i], part[i].tolist())]
        rows = [(i, j, str(total)) for i in range(k) if counts[i] for j, total in enumerate([*sums[i], counts[i]])]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()))], names=["cluster", "place", "part"])

    parts = numbers.mapInArrow(run, "cluster int, place int, part string")
    totals = {(r["cluster"], r["place"]): int(r["total"]) for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}  # at most k rows of each place
    moved = centroids.copy()
    for i in {i for i, _ in totals}:
        moved[i] = [totals[i, j] // totals[i, dimension] for j in range(dimension)]
    return moved


def assigned(numbers: DataFrame, centroids: np.ndarray, dimension: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for ids, x in batches_of(batches, dimension):
            of, distance = search.search(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return numbers.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: float = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    prepare(spark)
    numbers = whole_numbers(vectors, dimension, scale, id_col, vector_col)
    centroids = first_centroids(numbers, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = averaged(numbers, centroids, dimension)
    of = stored(assigned(numbers, centroids, dimension))
    digests = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()))
    # at most k numbers
    held = {r["cluster"]: int(r["held"]) for r in of.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("held")).collect()}
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    of_cluster = lambda values: F.get(F.array(*values), F.col("cluster"))
    inertias = [fits(held.get(i, 0)) for i in range(len(centroids))]
    digests = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()]
    return of.select("vec_id", "cluster", "distance", of_cluster(inertias).alias("cluster_inertia"), fits(sum(held.values())).alias("inertia"), of_cluster(digests).alias("centroid_sha256"))
