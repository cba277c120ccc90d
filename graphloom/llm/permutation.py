"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. A pivot's inverted file posts the vectors that have it among
their `prefix` nearest, with its place. A query meets only what its own nearest pivots post: candidates are ranked by the
footrule distance between the orders, summed along those inverted files, and the best are ranked again by the inner
product of the vectors themselves.

Nearness is the largest inner product. So that near pivots mean large products whatever the lengths, vectors get one
more component, which brings all to the length of the longest; a query's is zero.

Pivots are drawn from a bounded sample: the `pivots` vectors (all, if fewer) with the smallest hashes of their ids. Every
vector is indexed. `reach` times the square root of the number of vectors are ranked again for each query, whatever that
number, so that share falls as the table grows. Measured recall is in the README.

The index is dealt into shards of so many vectors that a task holds one, and each shard answers each block of queries;
the answers of the shards are merged by a partial top-k. An index is built once for each block, which is small beside
answering it. Vectors of different lengths are searched apart, each among its own; a small row for each length comes to
the driver, with its pivots.

Equal vectors share a candidate, so that a crowd of copies cannot keep others out.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; a query never meets rows of
its own id; rows equal in id and vector are one row; rows that share an id but not a vector are each a candidate, and the
query of that id is the smallest of its vectors; with fewer candidates than k, all are returned; an empty table gives an
empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

#: Components that a shard of vectors, or a block of queries, holds.
VALUES = 1 << 22
RESULT = "query_id long, rank int, vec_id long, score double"


class Shard:
    """The inverted files of some vectors (rows in the order of their ids); equal vectors are posted once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, prefix: int) -> None:
        _, first, group = np.unique(_bytes(vectors), return_index=True, return_inverse=True)
        by_id = np.argsort(first)  # number the different vectors by their smallest id
        group = np.argsort(by_id)[group.ravel()]
        vectors = vectors[first[by_id]]
        pairs = np.unique(np.stack([group, ids], 1), axis=0)  # rows equal in id and vector are one
        self.members, self.ends = pairs[:, 1], np.cumsum(np.bincount(pairs[:, 0]))
        self.vectors, self.pivots, self.prefix = vectors, pivots, min(prefix, len(pivots))
        extra = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0.0))
        order = nearest(np.hstack([vectors, extra[:, None]]), pivots, self.prefix).ravel()
        posted = np.argsort(order, kind="stable")
        self.rows = (posted // self.prefix).astype(np.int32)
        self.weight = (self.prefix - posted % self.prefix).astype(np.int16)
        self.begin = np.searchsorted(order[posted], np.arange(len(pivots) + 1)).tolist()

    def candidates(self, order: np.ndarray, many: int) -> np.ndarray:
        """The vectors with the least footrule distance to an order of pivots, ties to smaller ids.

        A pivot that is missing counts as just behind the prefix; then the distance falls by twice the smaller weight,
        prefix less place, of each pivot that both orders have.
        """
        near = np.zeros(len(self.vectors), np.int16 if self.prefix < 180 else np.int64)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.begin[pivot], self.begin[pivot + 1]
            near[self.rows[a:b]] += np.minimum(self.weight[a:b], self.prefix - place)
        if many >= len(near):
            return np.arange(len(near))
        cut = np.partition(near, len(near) - many)[len(near) - many]
        above = np.flatnonzero(near > cut)
        return np.concatenate([above, np.flatnonzero(near == cut)[: many - len(above)]])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query id, id and score of the k nearest of each query in this shard."""
        orders = nearest(np.hstack([queries, np.zeros((len(queries), 1))]), self.pivots, self.prefix)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own, query, order in zip(query_ids, queries, orders, strict=True):
            at = self.candidates(order, many)
            some = self.vectors[at]
            rough = some @ query
            if len(at) > k + 1:  # what cannot be among the best, whatever the rounding, goes first
                least = np.partition(rough, len(at) - k - 1)[len(at) - k - 1]
                keep = rough >= least - 1e-9 * max(1.0, abs(least))
                at, some = at[keep], some[keep]
            scores = (some * query).sum(1)  # summed row by row, so that the score is the vector's alone
            starts = self.ends[at - 1] * (at > 0)
            counts = np.minimum(self.ends[at] - starts, k + 1)  # of equal vectors, as many as can be needed
            ids = np.concatenate([self.members[a : a + n] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)])
            scores = np.repeat(scores, counts)
            scores, ids = scores[ids != own], ids[ids != own]
            best = np.lexsort((ids, -scores))[:k]
            found.append((np.full(len(best), own), ids[best], scores[best]))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))


def _bytes(rows: np.ndarray) -> np.ndarray:
    """Each row as one value that can be compared; zeros of either sign are one."""
    rows = np.ascontiguousarray(rows + 0.0)
    return rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()


def nearest(vectors: np.ndarray, pivots: np.ndarray, prefix: int, block: int = 1024) -> np.ndarray:
    """Numbers of the pivots with the largest products, in order."""
    found = np.empty((len(vectors), prefix), np.int16 if len(pivots) < 1 << 15 else np.int32)
    columns = np.ascontiguousarray(pivots.T, np.float32)
    for at in range(0, len(vectors), block):
        products = -(vectors[at : at + block].astype(np.float32) @ columns)
        some = np.argpartition(products, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(products), 1))
        some.sort(axis=1)
        found[at : at + block] = np.take_along_axis(some, np.argsort(np.take_along_axis(products, some, 1), axis=1, kind="stable"), 1)
    return found


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _among_one_length(rows: DataFrame, is_query: Column, dim: int, n: int, longest: float, k: int, pivots: int, prefix: int, reach: float, seed: int) -> DataFrame:
    """query_id, vec_id, score: the best of each shard, for vectors of one length."""
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id", "v").limit(pivots).collect()
    base = np.unique(np.array([r.v for r in drawn]), axis=0)
    base = np.hstack([base, np.sqrt(np.maximum(longest**2 - (base**2).sum(1), 0.0))[:, None]])
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = max(1024, VALUES // dim)
    shards, blocks = -(-n // size), max(1, -(-rows.filter(is_query).count() // size))
    spread = lambda by, m: F.pmod(F.xxhash64(F.lit(by), "vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("shard", spread(1, shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", spread(2, blocks)).withColumn("shard", every(shards))

    def answer(index: pa.Table, asked: pa.Table) -> pa.Table:
        got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if index.num_rows and asked.num_rows:
            index = index.sort_by("vec_id")
            shard = Shard(index["vec_id"].to_numpy(), _matrix(index["v"], dim), base, longest, prefix)
            many = math.ceil(reach * math.sqrt(n) * len(shard.vectors) / n) if n else 0
            got = shard.search(asked["vec_id"].to_numpy(), _matrix(asked["v"], dim), k, max(many, k + 1))
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(answer, "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    pivots: int = 4096,
    prefix: int = 80,
    reach: float = 12.0,
    seed: int = 0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each id that is a query (an expression on `vec_id`)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter("vec_id is not null").filter(usable(F.col("v")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy("dim").collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], RESULT)
    parts = [_among_one_length(rows.filter(F.size("v") == dim), is_query, dim, n, longest, k, pivots, prefix, reach, seed) for dim, n, longest in sizes]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = materialize(found, "neighbours")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
