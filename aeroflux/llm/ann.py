"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to blocks by hash; every pair of a query block and a candidate block is one tile. In a tile both sides are quantised to int8, one matrix product gives all inner products together with bounds of the quantisation error, and only pairs whose upper bound reaches the tile's k-th lower bound are computed again, exactly, in double precision. Bounded heaps merge the tiles' best k.

The result is exact: a pair is left out only when k better ones are proven. Tiles have a bounded size, so work spreads over tiles and no side is broadcast.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null identifier; vectors of different lengths are no candidates of each other; rows with the same identifier count once, with their best score; ties go to the smaller identifier; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare

#: Rows of a query block and of a candidate block.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries of a block that are compared at once.
STRIP = 256


def usable(vector: str) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(math.inf)) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and each row's scale: x is codes * scale within half a scale."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def scaled(x: np.ndarray, together: bool) -> np.ndarray:
    """x divided by a power of two, one for each row or one for all, so that no component is over 1 and no product overflows. Neither changes the order of a query's candidates."""
    most = np.abs(x).max(axis=None if together else 1, initial=0.0, keepdims=not together)
    return np.ldexp(x, -np.frexp(most)[1])


def bounds(q: np.ndarray, c: np.ndarray, quantised: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products of all pairs and how far each can be from the truth.

    |q.c - q'.c'| <= |q - q'|_1 max|c| + |q'|_1 max|c - c'|, each error of a component being at most half a scale. Sums of int8 products stay below 2**24 for up to 1,040 components, so a float32 product of the codes is exact there; longer vectors use float64.
    """
    (q8, q_scale), (c8, c_scale) = quantise(q), quantised or quantise(c)
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    about = (q8.astype(kind) @ c8.astype(kind).T) * q_scale[:, None] * c_scale[None, :]
    # both parts of the bound are products of a query's and a candidate's number
    q_error, q_norm = np.abs(q - q8 * q_scale[:, None]).sum(axis=1), np.abs(q8 * q_scale[:, None]).sum(axis=1)
    c_error, c_most = np.abs(c - c8 * c_scale[:, None]).max(axis=1), np.abs(c).max(axis=1)
    error = q_error[:, None] * c_most[None, :] + q_norm[:, None] * c_error[None, :]
    return about, error * (1 + 1e-6) + 1e-9 * np.abs(about) + 1e-300


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up from the first component to the last in double precision."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += q[:, i] * c[:, i]
    return total


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, candidate, score) of each query in one tile."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    # of equal vectors only the k + 1 smallest identifiers can be among the nearest
    _, kind = np.unique(vectors, axis=0, return_inverse=True)
    kind = kind.ravel()
    by_kind = np.argsort(kind, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(kind[by_kind])) + 1]
    fresh = np.ones(len(ids), bool)
    same = (kind[by_kind][1:] == kind[by_kind][:-1]) & (ids[by_kind][1:] == ids[by_kind][:-1])
    fresh[by_kind[1:][same]] = False  # a row given twice
    counted = np.cumsum(fresh[by_kind])
    place = counted - np.repeat(counted[starts] - fresh[by_kind][starts], np.diff(np.r_[starts, len(ids)]))
    keep = np.zeros(len(ids), bool)
    keep[by_kind] = fresh[by_kind] & (place <= k + 1)
    ids, vectors = ids[keep], vectors[keep]
    most_alike = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
    wanted = (k + 1) * most_alike  # the query's own row, and identifiers with several vectors
    found = []
    even = scaled(vectors, together=True)
    codes = quantise(even)
    for at in range(0, len(query_ids), STRIP):
        q_ids, q = query_ids[at : at + STRIP], queries[at : at + STRIP]
        about, error = bounds(scaled(q, together=False), even, codes)
        if len(ids) > wanted:
            least = -np.partition(-(about - error), wanted - 1, axis=1)[:, wanted - 1]
            rows, columns = np.nonzero(about + error >= least[:, None])
        else:
            rows, columns = (x.ravel() for x in np.indices(about.shape))
        own = q_ids[rows] == ids[columns]
        rows, columns = rows[~own], columns[~own]
        score = np.concatenate([exact(q[rows[i : i + 65536]], vectors[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        best = np.lexsort((ids[columns], -score, q_ids[rows]))
        rows, columns, score = rows[best], columns[best], score[best]
        who, which = q_ids[rows], ids[columns]
        if most_alike > 1 or len(np.unique(q_ids)) < len(q_ids):
            seen = pd.DataFrame({"q": who, "c": which}).duplicated().to_numpy()
            who, which, score = who[~seen], which[~seen], score[~seen]
        first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
        rank = np.arange(len(who)) - np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(who)]))
        short = rank < k
        found.append((who[short], which[short], score[short]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (query_ids[:0], ids[:0], np.zeros(0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest inner product, its own row left out."""
    prepare(vectors.sparkSession)

    def side(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))  # cast in the tiles: floats are half as much to move

    q, c = side(queries), side(vectors)
    n_q, n_c = q.count(), c.count()
    q_blocks, c_blocks = max(1, math.ceil(n_q / query_block)), max(1, math.ceil(n_c / candidate_block))
    # floats keep their exact value through the shuffle; sides meet in tiles of bounded size
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), F.size("v").alias("d"), "id", "v").withColumn("cb", all_of(c_blocks))
    c = c.select(F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int").alias("cb"), F.size("v").alias("d"), "id", "v").withColumn("qb", all_of(q_blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        part = lambda t: (t["id"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1))
        return pa.table([pa.array(x, k) for x, k in zip(tile(*part(left), *part(right), k), kinds)], names)

    tiles = q.groupBy("qb", "cb", "d").cogroup(c.groupBy("qb", "cb", "d")).applyInArrow(run, "query_id long, vec_id long, score double")
    return merge(tiles, k)


def merge(tiles: DataFrame, k: int) -> DataFrame:
    """The tiles' lists of each query through a heap of k entries."""
    parts = max(1, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, candidate, score in zip(*(column.to_pylist() for column in batch.columns)):
                heap = heaps.setdefault(query, [])
                entry = (score, -candidate)
                if len(heap) < k or entry > heap[0]:
                    twin = next((x for x in heap if x[1] == -candidate), None)
                    if twin is not None:
                        if twin >= entry:
                            continue
                        heap.remove(twin)
                        heapq.heapify(heap)
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, entry)
        rows = [(query, rank, -minus, score) for query, heap in heaps.items() for rank, (score, minus) in enumerate(sorted(heap, reverse=True), 1)]
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    return tiles.repartition(parts, "query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")
