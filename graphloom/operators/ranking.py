"""PageRank and the importance scores built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import discard, materialize

from .callgraph import closure, degrees

# Levels of importance, from the highest.
LEVELS = ((20, "Critical"), (15, "High"), (10, "Medium"), (5, "Low"), (None, "Minimal"))
# Share of the hybrid score that each part has.
HYBRID = {"pagerank": 0.4, "traditional": 0.4, "complexity": 0.2}


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 1000, rounds: int | None = None, weight: str | None = None) -> DataFrame:
    """id, rank over distinct edges; the mass of nodes without callees is spread evenly.

    weight: a column of the edges by which a node's rank is shared out (the largest of equal edges); evenly without one.

    nodes: id. Stops when all ranks together move by less than tolerance * nodes, or after `rounds` if given; ranks that do not settle in max_rounds are an error. Each round
    is one join and one aggregate on the edges, and is written to the shared folder. The ranks of all nodes are never broadcast.
    """
    e = edges.groupBy("src", "dst").agg((F.max(weight) if weight else F.lit(1)).alias("weight"))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    e = materialize(e.join(out, "src").select("src", "dst", "weight", "out"), "links")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    has_out = out.select(F.col("src").alias("id"), F.lit(True).alias("calls"))
    ranks = materialize(nodes.select("id").join(has_out, "id", "left").select("id", F.coalesce("calls", F.lit(False)).alias("calls"), F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(rounds or max_rounds):
        dangling = ranks.filter(~F.col("calls")).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = e.join(ranks.select(F.col("id").alias("src"), "rank").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("weight") / F.col("out")).alias("got"))
        base = (1 - damping) / n + damping * dangling / n
        fresh = ranks.join(given.hint("merge"), "id", "left").select("id", "calls", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("before"))
        fresh = materialize(fresh, "ranks")
        moved = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        discard(ranks)
        ranks = fresh.drop("before")
        if rounds is None and moved < tolerance * n:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")
    return ranks.select("id", "rank")


def complexity_factor(score: Column) -> Column:
    """1, and 0.3 times the decimal logarithm of a positive score more."""
    return F.when(score > 0, 1 + F.log10(score + 1) * 0.3).otherwise(F.lit(1.0))


def level(score: Column) -> Column:
    chain = F
    for least, name in LEVELS[:-1]:
        chain = chain.when(score >= least, name)
    return chain.otherwise(LEVELS[-1][1])


def traditional(functions: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """id, score, importance_level and the parts: callees, callers, reachable functions, place on call chains.

    A chain is the shortest path of each reachable pair up to max_depth; a function's depth part sums the logarithm of
    the chain's nodes over the pairs it starts.
    """
    d = degrees(functions, edges)
    reach = closure(edges, max_depth).filter("src != dst")
    far = reach.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reachable"), F.sum(F.log2(F.col("depth") + F.lit(2.0))).alias("depth_impact"))
    x = functions.select("id", "complexity_score").join(d, "id").join(far, "id", "left").fillna(0, ["reachable"]).fillna(0.0, ["depth_impact"])
    out, into = F.col("out_degree"), F.col("in_degree")
    hub = F.when((out > 0) & (into > 0), F.least(out, into) * 0.5).otherwise(0.0)
    special = F.when((out <= 2) & (into >= 5), into * 0.2).otherwise(0.0) + F.when(out >= 5, out * 0.1).otherwise(0.0)
    base = out * 1.0 + F.col("reachable") * 0.8 + F.col("depth_impact") * 0.6 + hub * 1.2 + into * 0.7 + special
    score = F.round(base * complexity_factor(F.col("complexity_score")), 2)
    return x.select("id", "out_degree", "in_degree", "reachable", score.alias("score")).withColumn("importance_level", level(F.col("score")))


def pagerank_importance(functions: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """id, pagerank, score (times complexity and 1000), importance_level."""
    x = functions.select("id", "complexity_score").join(pagerank(functions.select("id"), edges, **options), "id")
    score = F.round(F.col("rank") * complexity_factor(F.col("complexity_score")) * 1000, 2)
    return x.select("id", F.col("rank").alias("pagerank"), score.alias("score")).withColumn("importance_level", level(F.col("score")))


def hybrid(functions: DataFrame, edges: DataFrame, max_depth: int = 3, **options) -> DataFrame:
    """id, score, importance_level: shares of the best PageRank and traditional scores, and of complexity."""
    t = traditional(functions, edges, max_depth).select("id", F.col("score").alias("t"))
    p = pagerank_importance(functions, edges, **options).select("id", F.col("score").alias("p"))
    x = materialize(functions.select("id", "complexity_score").join(t, "id").join(p, "id"), "scores")
    best_t, best_p = x.agg(F.max("t"), F.max("p")).first()
    part = lambda c, best: F.col(c) / best * 100 if best else F.lit(0.0)
    factor = F.round(complexity_factor(F.col("complexity_score")), 2)
    score = HYBRID["pagerank"] * part("p", best_p) + HYBRID["traditional"] * part("t", best_t) + HYBRID["complexity"] * 50 * (factor - 1)
    return x.select("id", F.round(score, 2).alias("score")).withColumn("importance_level", level(F.col("score")))


def distribution(scores: DataFrame) -> DataFrame:
    """importance_level, n for all five levels."""
    spark = scores.sparkSession
    names = spark.createDataFrame([(name,) for _, name in LEVELS], "importance_level string")
    counts = scores.groupBy("importance_level").agg(F.count("*").alias("n"))
    return names.join(counts, "importance_level", "left").select("importance_level", F.coalesce("n", F.lit(0)).alias("n"))


def trends(scores: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per level its count, mean, largest and smallest score; and its k best functions with their rank."""
    stats = scores.groupBy("importance_level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))
    order = Window.partitionBy("importance_level").orderBy(F.desc("score"), "id")
    return stats, scores.withColumn("rnk", F.row_number().over(order).cast("int")).filter(f"rnk <= {k}").select("importance_level", "rnk", "id", "score")


def compare(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """One row: n_common of the two lists of k best, and their scores' correlation if there is more than one."""
    best = lambda df, name: df.orderBy(F.desc("score"), "id").limit(k).select("id", F.col("score").alias(name))
    both = best(a, "a").join(best(b, "b"), "id")
    return both.agg(F.count("*").alias("n_common"), F.when(F.count("*") > 1, F.round(F.corr("a", "b"), 3)).alias("correlation"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: n, n_critical, n_high, and their shares."""
    n = F.count("*")
    hit = {name: F.count_if(F.col("importance_level") == name) for name in ("Critical", "High")}
    return scores.agg(n.alias("n"), *[x.alias(f"n_{k.lower()}") for k, x in hit.items()], *[F.round(x / n, 6).alias(f"share_{k.lower()}") for k, x in hit.items()])
