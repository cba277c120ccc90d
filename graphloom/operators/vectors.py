"""Similarity of vectors: exact top-k, joins above a threshold, cells, clusters, groups of near-duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

#: Components that a cell of vectors holds.
VALUES = 1 << 20


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; products are summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def sparse_cosine(a: Column, vector: list[float]) -> Column:
    """Cosine with a vector of few components other than 0; a's length is worked out where the product is not 0.

    a has no null or endless components, for products with 0 are left out.
    """
    part = F.lit(0.0)
    for i, x in enumerate(vector):
        if x:
            part = part + F.get(a, F.lit(i)) * F.lit(float(x))
    size = F.sqrt(dot(a, a)) * F.lit(math.sqrt(sum(float(x) * float(x) for x in vector)))
    return F.when(part == 0, 0.0).otherwise(part / size)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", threshold: float | None = None, exclude: int | None = None, sparse: bool = False) -> DataFrame:
    """vec_id, score, rnk of the k nearest to one vector. l2 takes the smallest distances, and those up to the threshold.

    sparse: as sparse_cosine, for a query of few components other than 0 and vectors without null or endless ones.

    One scan and a top-k in each task; only k rows of each meet.
    """
    f = {"cosine": cosine, "ip": dot, "l2": distance}[metric]
    v = doubles(F.col("embedding"))
    rows = vectors.select("vec_id", (sparse_cosine(v, query) if sparse else f(v, literal(query))).alias("score"))
    if exclude is not None:
        rows = rows.filter(F.col("vec_id") != exclude)
    if threshold is not None:
        rows = rows.filter(F.col("score") <= threshold if metric == "l2" else F.col("score") >= threshold)
    order = [F.asc("score") if metric == "l2" else F.desc("score"), F.col("vec_id")]
    return rows.orderBy(*order).limit(k).withColumn("rnk", F.row_number().over(Window.orderBy(*order)).cast("int"))


def vector_of(vectors: DataFrame, vec_id: int) -> list[float] | None:
    """The vector of an id."""
    row = vectors.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return None if row is None else list(row[0])


def similar_to(vectors: DataFrame, vec_id: int, k: int = 10, threshold: float = 0.3, name: str = "name") -> DataFrame:
    """vec_id, score, rnk of the k vectors most similar to that of an id, without those of the same name; none if it is unknown."""
    row = vectors.filter(F.col("vec_id") == vec_id).select("embedding", name).first()
    others = vectors.filter(F.lit(False) if row is None else ~F.col(name).eqNullSafe(F.lit(row[name])))
    return top_k(others, [0.0] if row is None else list(row["embedding"]), k, threshold=threshold)


def similarity_matrix(vectors: DataFrame, ids: list[int]) -> DataFrame:
    """a, b, score: the cosine of every two of a short list of vectors, themselves included."""
    some = vectors.filter(F.col("vec_id").isin(ids)).select("vec_id", doubles(F.col("embedding")).alias("v"))
    one, two = some.select(F.col("vec_id").alias("a"), F.col("v").alias("x")), some.select(F.col("vec_id").alias("b"), F.col("v").alias("y"))
    pairs = vectors.sparkSession.createDataFrame([(i, j) for i in ids for j in ids], "a long, b long")
    return pairs.join(one, "a").join(two, "b").select("a", "b", cosine(F.col("x"), F.col("y")).alias("score"))


def hashed_search(vectors: DataFrame, query: list[float], k: int = 10, tables: int = 8, width: float = 2.0, seed: int = 42) -> DataFrame:
    """vec_id, score of the k best inner products among the vectors that share a random projection's bucket with the query."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.linalg import Vectors

    data = vectors.select("vec_id", doubles(F.col("embedding")).alias("v"), array_to_vector(doubles(F.col("embedding"))).alias("features")).filter("v is not null")
    if data.isEmpty():
        return data.select("vec_id", F.lit(0.0).alias("score"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed).fit(data)
    near = model.approxNearestNeighbors(data, Vectors.dense(query), 20 * k)
    return near.select("vec_id", dot(F.col("v"), literal(query)).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def similar_pairs(vectors: DataFrame, threshold: float, cells: int | None = None, seed: int = 42) -> DataFrame:
    """a, b (a < b), score of every two vectors of a cosine of at least the threshold.

    Exact, and every two are compared, dealt by their ids to `cells` (so many that one holds `VALUES` components unless
    given): at a low threshold in many dimensions no bound keeps cells apart. Each two cells meet in one task, as
    a matrix product in single precision; what that leaves within its error of the threshold is summed again in double
    precision, component by component. Work grows with the square of the table, what a task holds does not.

    Vectors of zeros, with null components or of other lengths are similar to none.
    """
    from graphloom.session import materialize

    v = F.col("embedding")
    rows = materialize(vectors.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null").filter(~F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x != 0)), "vectors")
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cells = cells or max(1, -(-n // max(256, min(VALUES // longest, n // 8))))
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(cells)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    dealt = dealt.select(F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "vec_id", "v")
    # by number, so that small cells of much work are not put into one task
    dealt = dealt.repartition(min(2 * cells * (cells + 1), 4096), "i", "j")
    kind = dict(rows.dtypes)["vec_id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        lengths = pc.list_value_length(table["v"])
        for dim in pc.unique(lengths).to_pylist():
            some = table.filter(pc.equal(lengths, dim))
            parts = [some.filter(pc.equal(some["cell"], k)) for k in pc.unique(some["cell"]).to_pylist()]
            if len(parts) > 1 or some["i"][0] == some["j"][0]:
                yield from _near(parts[0], parts[-1], dim, threshold)

    return dealt.groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, score double")


def _near(left: pa.Table, right: pa.Table, dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b, score of the pairs between two cells, or within one."""
    (one, x), (two, y) = ((t["vec_id"].combine_chunks(), _units(t["v"], dim)) for t in (left, right))
    slack, small = (dim + 8) * 2.0**-22, y.astype(np.float32).T
    step = max(1, (1 << 23) // len(y))
    for at in range(0, len(x), step):
        near = np.flatnonzero(~(x[at : at + step].astype(np.float32) @ small < threshold - slack))
        for begin in range(0, len(near), 1 << 16):
            r, c = np.divmod(near[begin : begin + (1 << 16)], len(y))
            score = np.cumsum(x[at + r] * y[c], axis=1)[:, -1]
            sure = ~(score < threshold)
            a, b = one.take(pa.array(at + r[sure])), two.take(pa.array(c[sure]))
            turned = pc.greater(a, b)
            low, high, score = pc.if_else(turned, b, a), pc.if_else(turned, a, b), pa.array(score[sure])
            # within a cell each pair is met from both sides
            keep = pc.less(a, b) if left is right else pc.not_equal(a, b)
            yield pa.RecordBatch.from_arrays([low.filter(keep), high.filter(keep), score.filter(keep)], ["a", "b", "score"])


def _units(v: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows scaled to length one, sums taken component by component."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in v.chunks])
    x = flat.astype(np.float64).reshape(-1, dim)
    return x / np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """vec_id, group (its smallest id): vectors joined by a chain of pairs."""
    return connected_components(pairs, "a", "b").select(F.col("node").alias("vec_id"), F.col("component").alias("group"))


def leader_groups(pairs: DataFrame) -> DataFrame:
    """leader, member, score: vectors in the order of their ids lead if no earlier leader has them; members may repeat.

    A vector is a leader unless a smaller leader is similar to it, which is settled from the smallest id upwards: each
    round fixes the leaders all of whose smaller neighbours are known not to lead.
    """
    from graphloom.session import materialize

    links = materialize(pairs.select("a", "b", "score"), "pairs")
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    left = materialize(nodes, "open")
    leaders = left.limit(0)
    while not left.isEmpty():
        waits = links.join(left.withColumnRenamed("id", "a"), "a").join(left.withColumnRenamed("id", "b"), "b").select(F.col("b").alias("id")).distinct()
        fresh = materialize(left.join(waits, "id", "left_anti"), "leaders")
        led = links.join(fresh.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        left = materialize(left.join(fresh, "id", "left_anti").join(led, "id", "left_anti"), "open")
        leaders = leaders.unionByName(fresh)
    return links.join(leaders.withColumnRenamed("id", "a"), "a").select(F.col("a").alias("leader"), F.col("b").alias("member"), "score")


def kmeans(vectors: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """vec_id, cluster; no more clusters than vectors."""
    data = vectors.select("vec_id", array_to_vector(doubles(F.col("embedding"))).alias("features")).filter("features is not null")
    k = min(k, data.count())
    if k < 2:
        return data.select("vec_id", F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data).select("vec_id", "cluster")


def cell_search(vectors: DataFrame, query: list[float], k: int = 10, cells: int = 100, probes: int = 10, train: int = 10_000, seed: int = 42) -> DataFrame:
    """vec_id, score of the k best inner products among the vectors of the `probes` cells nearest to the query.

    Cells are k-means centres of at most `train` vectors, those with the smallest hashes of their ids; all are indexed.
    """
    data = vectors.select("vec_id", doubles(F.col("embedding")).alias("v"), array_to_vector(doubles(F.col("embedding"))).alias("features")).filter("v is not null")
    sample = data.orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(train)
    n = min(cells, sample.count())
    if n < 2:
        return top_k(vectors, query, k, "ip").select("vec_id", "score")
    model = KMeans(k=n, seed=seed, featuresCol="features", predictionCol="cell").fit(sample)
    centres = sorted(range(len(model.clusterCenters())), key=lambda i: sum((a - b) ** 2 for a, b in zip(model.clusterCenters()[i], query, strict=True)))
    near = model.transform(data).filter(F.col("cell").isin(centres[:probes]))
    return near.select("vec_id", dot(F.col("v"), literal(query)).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
