"""The driver's tables as the canonical tables of the engine: functions, calls, containment, contents, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read_table


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each function: id, seq (its place in the corpus), name, class, file, sizes and complexity."""
    p = read_table(spark, sf_dir, "part")
    cc = F.col("p_partkey") % 17
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_brand").alias("parent_class"),
        F.col("p_type").alias("file_path"), F.col("p_size").cast("long").alias("lines_of_code"), cc.alias("cyclomatic_complexity"),
        (F.col("p_partkey") % 7).alias("parameters"), (F.col("p_size") % 5).cast("long").alias("branch_count"),
        (cc * F.col("p_size") / F.lit(10.0)).cast("double").alias("complexity_score"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records src, dst (a multiset): the first and second line of an order."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    second = lines.filter("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return first.join(second, "l_orderkey").select("src", "dst")


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository, file and function names that contain each other: region, nation, supplier."""
    r, n, s = (read_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("r_name").alias("repository"), F.col("n_name").alias("file_path"), F.col("s_name").alias("name"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rows: id, content, language, filepath."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("filepath"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search history: id, query, query_type, ts, top_similarity, result_count."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("query_type"), "ts",
        F.col("value").alias("top_similarity"), F.get_json_object("props", "$.k").cast("long").alias("result_count"),
    )


#: The same tables as common table expressions, for the SQL of the queries.
SQL = """functions AS (SELECT p_partkey AS id, p_partkey AS seq, p_name AS name, p_brand AS parent_class, p_type AS file_path,
  CAST(p_size AS BIGINT) AS lines_of_code, p_partkey % 17 AS cyclomatic_complexity, p_partkey % 7 AS parameters, CAST(p_size % 5 AS BIGINT) AS branch_count,
  CAST((p_partkey % 17) * p_size / CAST(10 AS DOUBLE) AS DOUBLE) AS complexity_score FROM part),
calls AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
edges AS (SELECT DISTINCT src, dst FROM calls WHERE src <> dst),
contents AS (SELECT doc_id AS id, text AS content, lang AS language, source AS filepath FROM documents),
history AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS query, event_type AS query_type, ts, value AS top_similarity, CAST(json_extract_string(props, '$.k') AS BIGINT) AS result_count FROM events)"""
