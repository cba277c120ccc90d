"""Merging of search results that have scores of different kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_total


def merge(left: DataFrame, right: DataFrame, keys: list[str], weights: tuple[float, float] = (0.7, 0.3), limit: int | None = None) -> DataFrame:
    """keys, left_score, right_score, combined_score, rnk: a full outer join of (keys, score); a missing score is 0.

    limit: only so many of the best. Without one all are ranked, range by range.
    """
    a = left.select(*keys, F.col("score").alias("left_score"))
    b = right.select(*keys, F.col("score").alias("right_score"))
    both = a.join(b, keys, "full_outer").fillna(0.0, ["left_score", "right_score"])
    both = both.withColumn("combined_score", F.round(weights[0] * F.col("left_score") + weights[1] * F.col("right_score"), 6))
    order = [F.desc("combined_score"), *map(F.col, keys)]
    if limit is None:
        return running_total(both, order, F.lit(1), "rnk").withColumn("rnk", F.col("rnk").cast("int"))
    return both.orderBy(*order).limit(limit).withColumn("rnk", F.row_number().over(Window.orderBy(*order)).cast("int"))


def jaccard(a, b):
    """Shared part of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def structural_similarity(context: DataFrame, names: list[str]) -> DataFrame:
    """a, b, similarity for every two of a short list of names; context: name, callees, callers, complexity.

    The mean of shared callees, shared callers and how near the complexities are. One for a name itself, 0 for unknown ones.
    """
    spark = context.sparkSession
    asked = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    rows = context.filter(F.col("name").isin(names))
    a = rows.select(F.col("name").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("callees", "callers", "complexity")])
    b = rows.select(F.col("name").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("callees", "callers", "complexity")])
    near = 1 - F.abs(F.col("complexity_a") - F.col("complexity_b")) / F.greatest("complexity_a", "complexity_b", F.lit(1.0))
    score = (jaccard(F.col("callees_a"), F.col("callees_b")) + jaccard(F.col("callers_a"), F.col("callers_b")) + near) / 3
    joined = asked.join(a, "a", "left").join(b, "b", "left")
    return joined.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(F.round(score, 6), F.lit(0.0))).alias("similarity"))


def callee_similarity(context: DataFrame, names: list[str]) -> DataFrame:
    """a, b, similarity for every two of a short list of names: the shared part of their callees, 1 for a name itself."""
    spark = context.sparkSession
    asked = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    rows = context.filter(F.col("name").isin(names))
    joined = asked.join(rows.select(F.col("name").alias("a"), F.col("callees").alias("x")), "a", "left").join(rows.select(F.col("name").alias("b"), F.col("callees").alias("y")), "b", "left")
    return joined.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(F.round(jaccard(F.col("x"), F.col("y")), 6), F.lit(0.0))).alias("similarity"))


def changes(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """key, change: added, changed or deleted between two tables of marks."""
    o, n = old.select(key, F.col(mark).alias("was")), new.select(key, F.col(mark).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return o.join(n, key, "full_outer").select(key, kind.alias("change")).filter("change is not null")


def newest(df: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row for each key: that with the largest version (null the least), ties to the largest row, whatever the order of the input."""
    rank = F.struct(*([F.col(version)] if version else []), *[F.to_json(F.struct(F.col(c))) for c in df.columns if c not in keys])
    return df.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct("*"), rank).alias("row")).select("row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """The old rows whose keys are not among the new, and of the new rows the newest of each key."""
    fresh = newest(new, keys, version)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def with_cache(wanted: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(wanted with the cache's values, rows to add to the cache). compute: from distinct missing keys to rows of the cache."""
    missing = wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
    fresh = compute(missing)
    return wanted.join(cache.unionByName(fresh), key, "left"), fresh
