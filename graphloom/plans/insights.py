"""Registered queries of relations by name and of answers that join several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import adapters as A
from graphloom.operators import callgraph as G
from graphloom.operators import complexity, ranking, relations, vectors
from graphloom.plans import profile
from graphloom.plans.registry import query
from graphloom.session import read_table

_SCORE = "round(0.4::DOUBLE * cyclomatic_complexity + 0.01::DOUBLE * lines_of_code + 0.3::DOUBLE * branch_count + 0.1::DOUBLE * parameters, 6)"
_LEVELS = f"scored AS (SELECT CASE WHEN {_SCORE} < 10 THEN 'simple' WHEN {_SCORE} < 25 THEN 'moderate' ELSE 'complex' END AS level FROM functions)"
_OVERVIEW = """over AS (SELECT 'functions' AS section, 'functions' AS name, count(*)::DOUBLE AS value FROM functions UNION ALL SELECT 'functions', 'avg_complexity', round(avg(complexity_score), 6) FROM functions
UNION ALL SELECT 'functions', 'max_complexity', max(complexity_score) FROM functions UNION ALL SELECT 'functions', 'min_complexity', min(complexity_score) FROM functions
UNION ALL SELECT 'levels', level, count(*)::DOUBLE FROM scored GROUP BY level
UNION ALL SELECT 'calls', CASE WHEN a.file_path IS NOT DISTINCT FROM b.file_path THEN 'within_file' ELSE 'between_files' END, count(*)::DOUBLE FROM edges JOIN functions a ON a.id = src JOIN functions b ON b.id = dst GROUP BY 2)"""


def _edges(spark, d):
    return G.distinct_edges(A.calls(spark, d))


@query("SELECT parent_class, id, name, file_path FROM functions WHERE parent_class = 'Brand#13'")
def j6_class_methods(spark, d):
    return relations.class_methods(A.functions(spark, d), "Brand#13")


@query("""WITH f AS (SELECT id, regexp_extract(coalesce(content, ''), '([A-Za-z]{6,})', 1) AS name, filepath AS file_path, content FROM contents), n AS (SELECT DISTINCT name FROM f WHERE name <> ''),
i AS (SELECT f.id AS src, n.name, f.file_path AS from_path FROM f JOIN n ON contains(f.content, n.name) WHERE NOT contains(f.content, 'def ' || n.name))
SELECT DISTINCT src, f.id AS dst FROM i JOIN f ON f.name = i.name WHERE from_path = f.file_path OR contains(f.file_path, i.name)""")
def j10_calls_by_content(spark, d):
    rows = A.contents(spark, d).select("id", F.regexp_extract(F.coalesce("content", F.lit("")), "([A-Za-z]{6,})", 1).alias("name"), F.col("filepath").alias("file_path"), "content")
    return relations.calls_by_content(rows)


@query("""WITH t AS (SELECT name, file_path AS stem, parent_class, max({'d': md5(name), 'l': 'complex', 's': CAST(id AS VARCHAR)}) AS told FROM functions WHERE complexity_score > 5 GROUP BY name, file_path, parent_class)
SELECT f.id, told.d AS description, coalesce(told.l, 'unknown') AS level, coalesce(told.s, '') AS summary, false AS has_error
FROM functions f LEFT JOIN t ON f.name = t.name AND f.file_path = t.stem AND f.parent_class IS NOT DISTINCT FROM t.parent_class""")
def j12_described(spark, d):
    f = A.functions(spark, d)
    told = f.filter("complexity_score > 5").select(
        "name", F.col("file_path").alias("stem"), "parent_class", F.md5(F.col("name").cast("binary")).alias("description"), F.lit("complex").alias("level"),
        F.col("id").cast("string").alias("summary"), F.lit(None).cast("string").alias("error"),
    )
    return relations.described(f, told).select("id", "description", "level", "summary", "has_error")


@query(f"WITH {_LEVELS} SELECT level, count(*) AS n FROM scored GROUP BY level")
def g17_level_distribution(spark, d):
    return complexity.scored(A.functions(spark, d)).groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level")


@query(f"WITH {_LEVELS}, {_OVERVIEW} SELECT * FROM over")
def g18_graph_overview(spark, d):
    return profile.graph_overview(A.functions(spark, d), _edges(spark, d))


@query(f"""WITH {_LEVELS}, {_OVERVIEW} SELECT * FROM over UNION ALL SELECT 'buckets', CASE WHEN coalesce(complexity_score, 0) < 2 THEN 'low' WHEN complexity_score < 5 THEN 'medium' WHEN complexity_score < 10 THEN 'high' ELSE 'very_high' END, count(*)::DOUBLE FROM functions GROUP BY 2
UNION ALL SELECT 'searches', query_type, count(*)::DOUBLE FROM history GROUP BY 2""")
def g23_code_insights(spark, d):
    return profile.code_insights(A.functions(spark, d), _edges(spark, d), A.history(spark, d))


@query(f"""WITH s AS (SELECT CASE WHEN {_SCORE} < 10 THEN 'simple' WHEN {_SCORE} < 25 THEN 'moderate' ELSE 'complex' END AS level, branch_count = 0 AS has_error FROM functions)
SELECT level, count(*) AS n, count(*) FILTER (WHERE has_error) AS n_errors FROM s GROUP BY level""")
def g25_description_outcomes(spark, d):
    f = A.functions(spark, d)
    return profile.description_outcomes(complexity.scored(f).join(f.select("id", (F.col("branch_count") == 0).alias("has_error")), "id"))


@query("""SELECT query_type AS stage, count(*) AS n, count(*) FILTER (WHERE top_similarity >= 50) AS n_ok, count(*) FILTER (WHERE NOT coalesce(top_similarity >= 50, false)) AS n_failed,
round(count(*) FILTER (WHERE top_similarity >= 50) / count(*), 6) AS success_rate, round(sum(top_similarity), 4) AS seconds FROM history GROUP BY ROLLUP (query_type)""")
def g27_run_summary(spark, d):
    return profile.run_summary(A.history(spark, d).select(F.col("query_type").alias("stage"), (F.col("top_similarity") >= 50).alias("ok"), F.col("top_similarity").alias("seconds")))


@query("""WITH s AS (SELECT dst AS id, count(*)::DOUBLE AS score FROM edges GROUP BY dst HAVING count(*) >= 5) SELECT f.id, coalesce(score, 0.0) AS importance_score,
CASE WHEN score IS NULL THEN 'Minimal' WHEN score >= 20 THEN 'Critical' WHEN score >= 15 THEN 'High' WHEN score >= 10 THEN 'Medium' ELSE 'Low' END AS importance_level FROM functions f LEFT JOIN s ON s.id = f.id""")
def r5_scores_written_back(spark, d):
    s = _edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("score")).filter("score >= 5")
    f = relations.with_scores(A.functions(spark, d), s.withColumn("importance_level", ranking.level(F.col("score"))))
    return f.select("id", "importance_score", "importance_level")


@query("SELECT id, 15.0::DOUBLE AS score, 'moderate' AS level FROM functions")
def r12_skipped(spark, d):
    return complexity.skipped(A.functions(spark, d))


@query("""WITH one AS (SELECT name FROM functions ORDER BY id LIMIT 1), chosen AS (SELECT f.id, f.name, f.complexity_score FROM functions f JOIN one ON one.name = f.name),
o AS (SELECT s.id, array_to_string(list_sort(list(DISTINCT f.name)), ',') AS callees, count(DISTINCT f.name) AS n FROM chosen s JOIN edges e ON e.src = s.id JOIN functions f ON f.id = e.dst GROUP BY s.id),
i AS (SELECT s.id, array_to_string(list_sort(list(DISTINCT f.name)), ',') AS callers, count(DISTINCT f.name) AS n FROM chosen s JOIN edges e ON e.dst = s.id JOIN functions f ON f.id = e.src GROUP BY s.id)
SELECT s.id, s.name, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers, CAST(coalesce(o.n, 0) AS INT) AS n_callees, CAST(coalesce(i.n, 0) AS INT) AS n_callers, complexity_score,
(SELECT count(*) FROM functions f, one WHERE f.name LIKE split_part(one.name, ' ', 1) || '%') AS n_similar FROM chosen s LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id""")
def r25_ecosystem(spark, d):
    f = A.functions(spark, d)
    name = f.orderBy("id").first()["name"]
    found = profile.ecosystem(f, _edges(spark, d), name, f.filter(F.col("name").startswith(name.split(" ")[0])))
    return found.select("id", "name", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"), "n_callees", "n_callers", "complexity_score", "n_similar")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id = 0) SELECT v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e), 6) AS score,
CAST(row_number() OVER (ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e) DESC, v.vec_id) AS INT) AS rnk FROM embeddings v, q WHERE v.label <> q.label AND list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 10""")
def v8_similar_functions(spark, d):
    e = read_table(spark, d, "embeddings")
    return vectors.similar_to(e, 0, 10, 0.1, name="label").withColumn("score", F.round("score", 6))
