"""Answers that join several operators: a function's profile, its surroundings, a search with profiles, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import callgraph as G
from graphloom.operators import centrality, complexity, metrics, ranking


def importance_profile(functions: DataFrame, edges: DataFrame, name: str, best: int = 100, depth: int = 3, rounds: int = 100) -> DataFrame:
    """One row for the first function (smallest id) of a name, none if there is no such function.

    id, name, rank (its place by PageRank if among the best), n_functions, community (its label), community_size,
    n_dependencies and n_direct (functions within `depth` calls, and called by itself).
    """
    chosen = functions.filter(F.col("name") == name).orderBy("id").limit(1).select("id", "name")
    ranks = G.top(ranking.pagerank(functions.select("id"), edges), best, F.desc("rank"), "id").select("id", F.col("rnk").alias("rank"))
    labels = centrality.label_propagation(functions.select("id"), edges, rounds)
    label = next(c for c in labels.columns if c != "id")
    sizes = labels.groupBy(label).agg(F.count("*").alias("community_size"))
    reach = G.closure(edges, depth, chosen).filter("src != dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_dependencies"), F.count_if(F.col("depth") == 1).alias("n_direct"))
    joined = chosen.join(ranks, "id", "left").crossJoin(functions.agg(F.count("*").alias("n_functions")))  # one row by one row
    joined = joined.join(labels, "id", "left").join(sizes, label, "left").join(reach, "id", "left").fillna(0, ["n_dependencies", "n_direct"])
    return joined.select("id", "name", "rank", "n_functions", F.col(label).alias("community"), "community_size", "n_dependencies", "n_direct")


def ecosystem(functions: DataFrame, edges: DataFrame, name: str, similar: DataFrame) -> DataFrame:
    """A row for each function of a name: its callees, callers and their numbers, scores, and n_similar.

    similar: what a search for the name has found, a row for each.
    """
    some = functions.filter(F.col("name") == name)
    # two joins by a key: one on either end would compare every edge with every function of the name
    near = edges.join(some.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").unionByName(edges.join(some.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    context = G.function_context(functions, near).join(some.select("id", "complexity_score"), "id")
    counted = context.withColumns({"n_callees": F.size("callees"), "n_callers": F.size("callers")})
    return counted.crossJoin(similar.agg(F.count("*").alias("n_similar")))  # by one row


def graph_overview(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """section, name, value: complexity of all functions, functions by level, calls between files and within."""
    s = "complexity_score"
    stats = functions.agg(F.count("*").cast("double").alias("functions"), F.round(F.avg(s), 6).alias("avg_complexity"), F.max(s).alias("max_complexity"), F.min(s).alias("min_complexity"))
    long = stats.select(F.lit("functions").alias("section"), F.stack(F.lit(4), *[x for c in stats.columns for x in (F.lit(c), F.col(c))]).alias("name", "value"))
    levels = complexity.scored(functions).groupBy(F.lit("levels").alias("section"), F.col("level").alias("name")).agg(F.count("*").cast("double").alias("value"))
    f = functions.select("id", "file_path")
    ends = edges.join(f.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst")
    kind = F.when(F.col("a").eqNullSafe(F.col("b")), "within_file").otherwise("between_files")
    return long.unionByName(levels).unionByName(ends.groupBy(F.lit("calls").alias("section"), kind.alias("name")).agg(F.count("*").cast("double").alias("value")))


def code_insights(functions: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """section, name, value: the graph's overview, complexity buckets and searches by type."""
    buckets = metrics.complexity_buckets(functions).select(F.lit("buckets").alias("section"), F.col("bucket").alias("name"), F.col("n").cast("double").alias("value"))
    searches = metrics.search_analytics(history).select(F.lit("searches").alias("section"), F.col("query_type").alias("name"), F.col("n").cast("double").alias("value"))
    return graph_overview(functions, edges).unionByName(buckets).unionByName(searches)


def run_summary(runs: DataFrame) -> DataFrame:
    """stage, n, n_ok, n_failed, success_rate, seconds of a table of runs (stage, ok, seconds), and a row with a null stage for all."""
    counts = runs.rollup("stage").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.sum("seconds").alias("seconds"))
    return counts.select("stage", "n", "n_ok", (F.col("n") - F.col("n_ok")).alias("n_failed"), F.round(F.col("n_ok") / F.col("n"), 6).alias("success_rate"), F.round("seconds", 4).alias("seconds"))


def description_outcomes(descriptions: DataFrame) -> DataFrame:
    """level, n, n_errors of descriptions (level, has_error)."""
    return descriptions.groupBy("level").agg(F.count("*").alias("n"), F.count_if("has_error").alias("n_errors"))
