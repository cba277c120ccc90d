"""Aggregates over functions, files, classes, graphs and search history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .callgraph import degrees
from .ranges import running_total


def group_metrics(functions: DataFrame, by: str) -> DataFrame:
    """Per file or class: n_functions, total_lines, avg_lines, max_complexity, avg_complexity, n_public, n_private."""
    private = F.col("name").startswith("_")
    return functions.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n_functions"), F.sum("lines_of_code").alias("total_lines"), F.round(F.avg("lines_of_code"), 6).alias("avg_lines"),
        F.max("cyclomatic_complexity").alias("max_complexity"), F.round(F.avg("cyclomatic_complexity"), 6).alias("avg_complexity"),
        F.count_if(~private).alias("n_public"), F.count_if(private).alias("n_private"),
    )


def overall_metrics(functions: DataFrame) -> DataFrame:
    """One row over all functions, the unnamed among them."""
    return functions.agg(
        F.count("*").alias("n_functions"), F.count_if(F.col("parent_class").isNotNull()).alias("n_methods"), F.count_distinct("file_path").alias("n_files"),
        F.count_distinct("parent_class").alias("n_classes"), F.sum("lines_of_code").alias("total_lines"),
        F.round(F.avg("cyclomatic_complexity"), 6).alias("avg_complexity"), F.max("cyclomatic_complexity").alias("max_complexity"),
    )


def class_stats(functions: DataFrame, code: str | None = None) -> DataFrame:
    """Per class: n_methods, n_public, n_private (all that are not public), n_magic; names starting with _ aren't public.

    code: a column of source texts; then is_abstract, whether any of a class has `abstract` in it.
    """
    named = functions.filter("parent_class is not null").groupBy("parent_class")
    public = ~F.col("name").startswith("_")
    return named.agg(F.count("*").alias("n_methods"), F.count_if(public).alias("n_public"), F.count_if(~public).alias("n_private"), F.count_if(F.col("name").startswith("__")).alias("n_magic"), *([F.coalesce(F.bool_or(F.contains(code, F.lit("abstract"))), F.lit(False)).alias("is_abstract")] if code else []))


def dependency_complexity(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Per caller over its distinct callees: n, n_with_complexity, avg, max and min complexity, and the ids above 10."""
    c = functions.select(F.col("id").alias("dst"), F.col("cyclomatic_complexity").alias("cc"))
    return edges.join(c, "dst").groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("cc") > 0).alias("n_with_complexity"), F.round(F.avg("cc"), 6).alias("avg_cc"), F.max("cc").alias("max_cc"), F.min("cc").alias("min_cc"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cc") > 10, F.col("dst")))), lambda x: x.cast("string")), ",").alias("complex_ids"),
    )


def callers_by_file(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, file_path of its callers, n_callers."""
    f = functions.select(F.col("id").alias("src"), "file_path")
    return edges.join(f, "src").groupBy(F.col("dst").alias("id"), "file_path").agg(F.count("*").alias("n_callers"))


def graph_statistics(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges and mean, largest and smallest degree, in and out together."""
    d = degrees(functions, edges).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return d.agg(F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))


def bucket(score: Column) -> Column:
    """Complexity bucket; a missing score counts as none."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s < 2, "low").when(s < 5, "medium").when(s < 10, "high").otherwise("very_high")


def complexity_buckets(functions: DataFrame) -> DataFrame:
    return functions.groupBy(bucket(F.col("complexity_score")).alias("bucket")).agg(F.count("*").alias("n"))


def complexity_analysis(functions: DataFrame) -> DataFrame:
    """One row: n, mean, largest, smallest and population deviation of the score."""
    s = "complexity_score"
    return functions.agg(F.count(s).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"), F.round(F.stddev_pop(s), 6).alias("std"))


def search_analytics(history: DataFrame) -> DataFrame:
    """Per query type: n, avg_results, avg_similarity."""
    return history.groupBy("query_type").agg(F.count("*").alias("n"), F.round(F.avg("result_count"), 6).alias("avg_results"), F.round(F.avg("top_similarity"), 6).alias("avg_similarity"))


def duplicate_names(functions: DataFrame) -> DataFrame:
    """name, n, ids (in order) of each name that several functions have."""
    groups = functions.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).filter("n > 1")
    return groups.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


#: Quantiles by floor index: the value at place floor(n * q) of the sorted values.
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def floor_quantiles(values: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """One row: for each quantile the value (column v) at place floor(n * q) of the sorted values, from counts of different values."""
    counts = values.groupBy("v").agg(F.count("*").alias("c"))
    upto = running_total(counts, [F.col("v")], F.col("c"), "upto")
    n = values.count()
    return upto.agg(*[F.min(F.when(F.col("upto") > int(n * q), F.col("v"))).alias(name) for name, q in quantiles.items()])


def population_statistics(df: DataFrame, column: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """One row over positive values: n, mean, std (sample, 0 if n < 2), min, max, and quantiles by floor index."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v > 0")
    basic = values.agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return basic.crossJoin(floor_quantiles(values, quantiles or QUANTILES))  # one row by one row
