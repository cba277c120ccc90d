"""The registered queries of the engine and their SQL, over the canonical tables that the adapters make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import adapters as A
from graphloom.functions import text as T
from graphloom.operators import callgraph as G
from graphloom.operators import centrality, complexity, filters, hybrid, metrics, ranking, reach, vectors
from graphloom.operators.components import connected_components
from graphloom.plans import features, insights, profile, surface  # noqa: F401 - queries are registered on import
from graphloom.plans.registry import oracle_sql, queries, query  # noqa: F401 - the driver contract reads them here
from graphloom.session import read_table

def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.distinct_edges(A.calls(spark, d))


# --- call graph


@query("""WITH counted AS (SELECT f.id, f.name, count(*) AS call_count FROM calls c JOIN functions f ON c.dst = f.id GROUP BY f.id, f.name)
SELECT id, name, call_count, CAST(rnk AS INT) AS rnk FROM (SELECT *, row_number() OVER (ORDER BY call_count DESC, id) AS rnk FROM counted) WHERE rnk <= 10""")
def g1_most_called(spark, d):
    return G.most_called(A.functions(spark, d), A.calls(spark, d))


@query("""SELECT (SELECT count(*) FROM functions) AS n_nodes, (SELECT count(*) FROM calls) AS n_edges,
(SELECT count(*) FROM functions WHERE id NOT IN (SELECT dst FROM calls)) AS n_isolated""")
def g1_graph_counts(spark, d):
    return G.graph_counts(A.functions(spark, d), A.calls(spark, d))


@query("SELECT name, max_by(id, seq) AS id, min(seq) AS first_seq FROM functions GROUP BY name")
def j1_last_wins(spark, d):
    return G.resolve_names(A.functions(spark, d))


@query("""WITH r AS (SELECT name, max_by(id, seq) AS id FROM functions GROUP BY name)
SELECT c.src, r.id AS dst, count(*) AS n FROM calls c JOIN functions f ON f.id = c.dst JOIN r ON r.name = f.name GROUP BY 1, 2""")
def j1_named_calls(spark, d):
    return G.named_calls(A.functions(spark, d), A.calls(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("""SELECT id, name, id IN (SELECT dst FROM calls) AS internal FROM functions""")
def j2_called_or_not(spark, d):
    f, c = A.functions(spark, d).select("id", "name"), A.calls(spark, d).select(F.col("dst").alias("id"))
    return f.join(c, "id", "left_semi").withColumn("internal", F.lit(True)).unionByName(f.join(c, "id", "left_anti").withColumn("internal", F.lit(False)))


@query("""SELECT a.name AS caller, a.file_path AS caller_file, b.name AS callee, b.file_path AS callee_file, count(*) AS n FROM edges e JOIN functions a ON a.id = e.src JOIN functions b ON b.id = e.dst GROUP BY ALL""")
def j3_one_hop(spark, d):
    f = A.functions(spark, d)
    a = f.select(F.col("id").alias("src"), F.col("name").alias("caller"), F.col("file_path").alias("caller_file"))
    b = f.select(F.col("id").alias("dst"), F.col("name").alias("callee"), F.col("file_path").alias("callee_file"))
    return _edges(spark, d).join(a, "src").join(b, "dst").groupBy("caller", "caller_file", "callee", "callee_file").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT src, dst FROM calls)
SELECT src, dst, CAST(depth AS INT) AS depth, nodes FROM (
SELECT src, dst, 1 AS depth, src || '>' || dst AS nodes FROM e
UNION ALL SELECT a.src, b.dst, 2, a.src || '>' || a.dst || '>' || b.dst FROM e a JOIN e b ON a.dst = b.src WHERE NOT (a.src = b.src AND a.dst = b.dst)
UNION ALL SELECT a.src, c.dst, 3, a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src
  WHERE NOT (a.src = b.src AND a.dst = b.dst) AND NOT (b.src = c.src AND b.dst = c.dst) AND NOT (a.src = c.src AND a.dst = c.dst))""")
def j4_paths(spark, d):
    p = G.paths(A.calls(spark, d), 3)
    return p.withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">"))


@query("""SELECT a.file_path AS from_group, b.file_path AS to_group, count(*) AS n_calls FROM calls c JOIN functions a ON a.id = c.src JOIN functions b ON b.id = c.dst WHERE a.file_path <> b.file_path GROUP BY 1, 2""")
def g2_file_dependencies(spark, d):
    return G.grouped_dependencies(A.functions(spark, d), A.calls(spark, d), "file_path")


@query("""SELECT a.parent_class AS from_group, b.parent_class AS to_group, count(*) AS n_calls FROM calls c JOIN functions a ON a.id = c.src JOIN functions b ON b.id = c.dst WHERE a.parent_class <> b.parent_class GROUP BY 1, 2""")
def g2_class_dependencies(spark, d):
    return G.grouped_dependencies(A.functions(spark, d), A.calls(spark, d), "parent_class")


@query("SELECT src, dst FROM edges")
def g3_direct_without_loops(spark, d):
    return _edges(spark, d)


_REACH = """reach AS (SELECT src, dst, min(depth) AS depth FROM (SELECT src, dst, 1 AS depth FROM edges
UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src
UNION ALL SELECT a.src, c.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src) GROUP BY src, dst)"""


@query(f"WITH {_REACH} SELECT src, dst, CAST(depth AS INT) AS depth FROM reach")
def g3_closure(spark, d):
    return G.closure(_edges(spark, d), 3)


@query(f"WITH {_REACH}, n AS (SELECT src AS id, count(*) AS n_reachable FROM reach WHERE src <> dst GROUP BY 1) SELECT id, n_reachable FROM n ORDER BY n_reachable DESC, id LIMIT 10")
def g4_most_reaching(spark, d):
    n = G.closure(_edges(spark, d), 3).filter("src != dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_reachable"))
    return n.orderBy(F.desc("n_reachable"), "id").limit(10)


_FAR = "r1 AS MATERIALIZED (SELECT src, dst, 1 AS depth FROM edges)" + "".join(
    f""", f{k} AS MATERIALIZED (SELECT DISTINCT a.src, e.dst, {k} AS depth FROM {"r1" if k == 2 else f"f{k - 1}"} a JOIN edges e ON e.src = a.dst ANTI JOIN r{k - 1} r ON r.src = a.src AND r.dst = e.dst),
r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT * FROM f{k})"""
    for k in range(2, 21)
)


@query(f"WITH {_FAR} SELECT src, dst, CAST(depth AS INT) AS depth FROM r20")
def g3_closure_whole(spark, d):
    return G.closure(_edges(spark, d))


@query(f"WITH {_FAR} SELECT src AS id, count(*) AS n_reachable FROM r20 WHERE src <> dst GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def g4_most_reaching_whole(spark, d):
    n = reach.reached(_edges(spark, d)).select("id", F.col("n").alias("n_reachable"))
    return n.orderBy(F.desc("n_reachable"), "id").limit(10)


_DEG = """deg AS (SELECT f.id, (SELECT count(*) FROM edges e WHERE e.src = f.id) AS out_degree, (SELECT count(*) FROM edges e WHERE e.dst = f.id) AS in_degree FROM functions f)"""


@query(f"WITH {_DEG} SELECT id, out_degree, in_degree FROM deg")
def g5_degrees(spark, d):
    return G.degrees(A.functions(spark, d), _edges(spark, d))


@query(f"""WITH {_DEG} SELECT id, out_degree, in_degree, CASE WHEN out_degree > 0 AND in_degree > 0 THEN 'hub' WHEN in_degree > 0 THEN 'leaf' WHEN out_degree > 0 THEN 'root' ELSE 'isolated' END AS role FROM deg""")
def g6_impact(spark, d):
    return G.impact(A.functions(spark, d), _edges(spark, d))


@query("""SELECT a.src || '>' || a.dst AS cycle, CAST(2 AS INT) AS length FROM edges a JOIN edges b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def g7_cycles(spark, d):
    return G.simple_cycles(_edges(spark, d), 3)


_GROUP = """count(*) AS n_functions, CAST(sum(lines_of_code) AS BIGINT) AS total_lines, round(avg(lines_of_code), 6) AS avg_lines, max(cyclomatic_complexity) AS max_complexity,
round(avg(cyclomatic_complexity), 6) AS avg_complexity, count(*) FILTER (WHERE NOT starts_with(name, '_')) AS n_public, count(*) FILTER (WHERE starts_with(name, '_')) AS n_private"""


@query(f"SELECT file_path, {_GROUP} FROM functions GROUP BY file_path")
def g8_file_metrics(spark, d):
    return metrics.group_metrics(A.functions(spark, d), "file_path")


@query(f"SELECT parent_class, {_GROUP} FROM functions GROUP BY parent_class")
def g8_class_metrics(spark, d):
    return metrics.group_metrics(A.functions(spark, d), "parent_class")


@query("""SELECT count(*) AS n_functions, count(parent_class) AS n_methods, count(DISTINCT file_path) AS n_files, count(DISTINCT parent_class) AS n_classes, CAST(sum(lines_of_code) AS BIGINT) AS total_lines,
round(avg(cyclomatic_complexity), 6) AS avg_complexity, max(cyclomatic_complexity) AS max_complexity FROM functions""")
def g8_overall_metrics(spark, d):
    return metrics.overall_metrics(A.functions(spark, d))


@query("""SELECT source AS file_path, count(*) AS n_functions, count(quality) AS n_described FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id GROUP BY source""", tables=False)
def g10_file_descriptions(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels").groupBy("doc_id").agg(F.first("quality").alias("quality"))
    return docs.select("doc_id", "source").join(labels, "doc_id", "left").groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("n_functions"), F.count("quality").alias("n_described"))


@query("""SELECT parent_class, count(*) AS n_methods, count(*) FILTER (WHERE NOT starts_with(name, '_')) AS n_public, count(*) FILTER (WHERE starts_with(name, '_')) AS n_private, count(*) FILTER (WHERE starts_with(name, '__')) AS n_magic, coalesce(bool_or(contains(name, 'abstract')), false) AS is_abstract FROM functions GROUP BY 1""")
def g11_class_stats(spark, d):
    return metrics.class_stats(A.functions(spark, d), "name")


@query("""SELECT e.src AS id, count(*) AS n, count(*) FILTER (WHERE f.cyclomatic_complexity > 0) AS n_with_complexity, round(avg(f.cyclomatic_complexity), 6) AS avg_cc, max(f.cyclomatic_complexity) AS max_cc, min(f.cyclomatic_complexity) AS min_cc,
coalesce(string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY f.id) FILTER (WHERE f.cyclomatic_complexity > 10), '') AS complex_ids FROM edges e JOIN functions f ON f.id = e.dst GROUP BY e.src""")
def g12_dependency_complexity(spark, d):
    return metrics.dependency_complexity(A.functions(spark, d), _edges(spark, d))


@query("SELECT e.dst AS id, f.file_path, count(*) AS n_callers FROM edges e JOIN functions f ON f.id = e.src GROUP BY 1, 2")
def g13_callers_by_file(spark, d):
    return metrics.callers_by_file(A.functions(spark, d), _edges(spark, d))


@query("""SELECT r_name AS repository, count(DISTINCT n_name) AS n_files, count(*) AS n_functions FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""", tables=False)
def g14_containment_counts(spark, d):
    return A.containment(spark, d).groupBy("repository").agg(F.count_distinct("file_path").alias("n_files"), F.count("*").alias("n_functions"))


@query(f"""WITH {_DEG} SELECT count(*) AS n_nodes, CAST(sum(out_degree) AS BIGINT) AS n_edges, round(avg(in_degree + out_degree), 6) AS avg_degree, max(in_degree + out_degree) AS max_degree, min(in_degree + out_degree) AS min_degree FROM deg""")
def g15_graph_statistics(spark, d):
    return metrics.graph_statistics(A.functions(spark, d), _edges(spark, d))


_HOPS = 12
_MIN = "c0 AS (SELECT node, node AS component FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)), both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)" + "".join(
    f", c{k + 1} AS MATERIALIZED (SELECT c.node, least(any_value(c.component), min(n.component)) AS component FROM c{k} c JOIN both_ways ON both_ways.a = c.node JOIN c{k} n ON n.node = both_ways.b GROUP BY c.node)"
    for k in range(_HOPS)
)


@query(f"WITH {_MIN} SELECT node, component FROM c{_HOPS}")
def g16_components(spark, d):
    return connected_components(_edges(spark, d))


@query("""SELECT CASE WHEN complexity_score < 2 THEN 'low' WHEN complexity_score < 5 THEN 'medium' WHEN complexity_score < 10 THEN 'high' ELSE 'very_high' END AS bucket, count(*) AS n FROM functions GROUP BY 1""")
def g19_complexity_buckets(spark, d):
    return metrics.complexity_buckets(A.functions(spark, d))


@query("SELECT count(complexity_score) AS n, round(avg(complexity_score), 6) AS mean, max(complexity_score) AS max, min(complexity_score) AS min, round(stddev_pop(complexity_score), 6) AS std FROM functions")
def g20_complexity_analysis(spark, d):
    return metrics.complexity_analysis(A.functions(spark, d))


@query("SELECT language, filepath, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM contents GROUP BY 1, 2")
def g21_index_statistics(spark, d):
    return A.contents(spark, d).groupBy("language", "filepath").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query("SELECT query_type, count(*) AS n, round(avg(result_count), 6) AS avg_results, round(avg(top_similarity), 6) AS avg_similarity FROM history GROUP BY 1")
def g22_search_analytics(spark, d):
    return metrics.search_analytics(A.history(spark, d))


@query("SELECT query, count(*) AS n FROM history GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def g22_top_queries(spark, d):
    return A.history(spark, d).groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(10)


@query("SELECT name, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM functions GROUP BY name HAVING count(*) > 1")
def g24_duplicate_names(spark, d):
    return metrics.duplicate_names(A.functions(spark, d))


@query("""SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2""", tables=False)
def g25_label_distribution(spark, d):
    return read_table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def _population(column: str) -> str:
    return f"""WITH v AS (SELECT CAST({column} AS DOUBLE) AS v FROM functions WHERE {column} > 0), l AS (SELECT list_sort(list(v)) AS x, count(*) AS n FROM v)
SELECT (SELECT count(*) FROM v) AS n, (SELECT round(avg(v), 6) FROM v) AS mean, (SELECT round(coalesce(stddev_samp(v), 0), 6) FROM v) AS std, (SELECT min(v) FROM v) AS min, (SELECT max(v) FROM v) AS max,
x[CAST(floor(n * 0.25) AS INT) + 1] AS q25, x[CAST(floor(n * 0.5) AS INT) + 1] AS median, x[CAST(floor(n * 0.75) AS INT) + 1] AS q75 FROM l"""


@query(_population("lines_of_code"))
def g26_population(spark, d):
    return metrics.population_statistics(A.functions(spark, d), "lines_of_code")


@query("SELECT file_path, count(*) AS n FROM functions GROUP BY 1 ORDER BY n DESC, file_path LIMIT 20")
def g28_largest_files(spark, d):
    return A.functions(spark, d).groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(20)


@query("""SELECT DISTINCT src, dst FROM (SELECT a.src, a.dst FROM edges a WHERE a.src = 1 UNION ALL SELECT b.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 1
UNION ALL SELECT c.src, c.dst FROM edges a JOIN edges b ON a.dst = b.src AND NOT (a.src = b.src AND a.dst = b.dst) JOIN edges c ON b.dst = c.src WHERE a.src = 1)""")
def g29_call_graph_around(spark, d):
    e = _edges(spark, d)
    return G.graph_around(e, spark.createDataFrame([(1,)], "id long"), 3)


# --- joins


@query("SELECT src AS id, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges")
def j7_neighbours(spark, d):
    return G.neighbours(_edges(spark, d), A.functions(spark, d))


@query("""SELECT f.id, f.name, f.file_path, f.parent_class,
coalesce((SELECT string_agg(DISTINCT g.name, ',' ORDER BY g.name) FROM edges e JOIN functions g ON g.id = e.dst WHERE e.src = f.id), '') AS callees,
coalesce((SELECT string_agg(DISTINCT g.name, ',' ORDER BY g.name) FROM edges e JOIN functions g ON g.id = e.src WHERE e.dst = f.id), '') AS callers FROM functions f""")
def j8_context(spark, d):
    c = G.function_context(A.functions(spark, d), _edges(spark, d))
    return c.withColumns({x: F.array_join(x, ",") for x in ("callees", "callers")})


@query("""SELECT DISTINCT page_id, module FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS module FROM pages)""", tables=False)
def j11_imports(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("module")).distinct()


_VEC = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0), cos AS (SELECT v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, q)"""


@query(f"""WITH {_VEC}, a AS (SELECT vec_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT vec_id, CAST(label AS DOUBLE) / 10 AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20),
m AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, round(coalesce(a.score, 0), 6) AS left_score, coalesce(b.score, 0) AS right_score, round(0.7 * coalesce(a.score, 0) + 0.3 * coalesce(b.score, 0), 6) AS combined_score FROM a FULL JOIN b ON a.vec_id = b.vec_id)
SELECT *, CAST(row_number() OVER (ORDER BY combined_score DESC, vec_id) AS INT) AS rnk FROM m""")
def j13_hybrid_merge(spark, d):
    e = read_table(spark, d, "embeddings")
    a = vectors.top_k(e, vectors.vector_of(e, 0), 20)
    b = e.select("vec_id", (F.col("label").cast("double") / 10).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
    return hybrid.merge(a, b, ["vec_id"], limit=40).withColumn("left_score", F.round("left_score", 6))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45""", tables=False)
def j15_similar_pairs(spark, d):
    return vectors.similar_pairs(read_table(spark, d, "embeddings"), 0.45).withColumn("score", F.round("score", 6))


@query("""WITH o AS (SELECT doc_id AS path, md5(text) AS h FROM documents), n AS (SELECT doc_id * 2 AS path, md5(text) AS h FROM documents)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.h <> n.h""", tables=False)
def j18_changes(spark, d):
    # the new version has every text under twice its id
    t = read_table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return hybrid.changes(t, t.withColumn("path", F.col("path") * 2))


@query("""WITH n AS (SELECT doc_id * 2 AS doc_id, lang || '-new' AS lang FROM documents) SELECT * FROM n UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)""", tables=False)
def s13_upsert(spark, d):
    # the new version has every row under twice its id
    t = read_table(spark, d, "documents").select("doc_id", "lang")
    return hybrid.upsert(t, t.select((F.col("doc_id") * 2).alias("doc_id"), F.concat("lang", F.lit("-new")).alias("lang")), ["doc_id"])


# --- searches by attribute


@query("SELECT id, name, file_path FROM functions WHERE name = (SELECT name FROM functions WHERE id = 1)")
def f1_by_exact_name(spark, d):
    name = A.functions(spark, d).filter("id = 1").first()["name"]
    return filters.by_name(A.functions(spark, d), name).select("id", "name", "file_path")


@query("SELECT id, name, file_path FROM functions WHERE contains(name, 'a')")
def f1_by_part_of_name(spark, d):
    return filters.by_name(A.functions(spark, d), "a", exact=False).select("id", "name", "file_path")


@query("SELECT id, cyclomatic_complexity, lines_of_code FROM functions WHERE lines_of_code >= 10 AND lines_of_code <= 40 AND cyclomatic_complexity >= 5 ORDER BY cyclomatic_complexity DESC, id LIMIT 100")
def f2_by_complexity(spark, d):
    return filters.by_complexity(A.functions(spark, d), 10, 40, 5).select("id", "cyclomatic_complexity", "lines_of_code")


@query("SELECT id, file_path, complexity_score FROM functions WHERE contains(file_path, 'A') ORDER BY complexity_score DESC, id LIMIT 20")
def f4_by_path(spark, d):
    return filters.by_path(A.functions(spark, d), "A").select("id", "file_path", "complexity_score")


@query("SELECT id, complexity_score FROM functions WHERE complexity_score BETWEEN 5 AND 20 ORDER BY complexity_score DESC, id LIMIT 20")
def f5_by_score(spark, d):
    return filters.by_score(A.functions(spark, d), 5, 20).select("id", "complexity_score")


@query("SELECT id, language FROM (SELECT * FROM contents WHERE language = 'fr') ORDER BY id LIMIT 30")
def f7_metadata_before(spark, d):
    return filters.metadata(A.contents(spark, d), 30, ["id"], "pre", language="fr", unknown=1).select("id", "language")


@query("SELECT id, language FROM (SELECT * FROM contents ORDER BY id LIMIT 30) WHERE language = 'fr'")
def f7_metadata_after(spark, d):
    return filters.metadata(A.contents(spark, d), 30, ["id"], "post", language="fr").select("id", "language")


@query("SELECT id FROM contents WHERE contains(lower(content), 'license') OR contains(lower(filepath), 'license') OR contains(lower(content), 'idiot') OR contains(lower(filepath), 'idiot')")
def f8_any_keyword(spark, d):
    return filters.any_keyword(A.contents(spark, d), ["license", "idiot"], ["content", "filepath"]).select("id")


@query("SELECT id, complexity_score FROM functions WHERE complexity_score > 5 ORDER BY complexity_score DESC, id LIMIT 10")
def f10_most_complex(spark, d):
    return filters.ranked(A.functions(spark, d), F.col("complexity_score") > 5, limit=10).select("id", "complexity_score")


# --- features


@query("""SELECT id, sha256(content) AS content_hash, md5(content) AS key, CAST(length(content) AS BIGINT) AS n_chars, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines, contains(content, '\"\"\"') AS has_docstring FROM contents""")
def p18_file_records(spark, d):
    c = A.contents(spark, d)
    return c.select(
        "id", F.sha2("content", 256).alias("content_hash"), F.md5(F.col("content").cast("binary")).alias("key"), F.length("content").cast("long").alias("n_chars"),
        F.size(F.split("content", "\n")).cast("long").alias("n_lines"), F.contains("content", F.lit('"""')).alias("has_docstring"),
    )


@query("""SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS base, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(regexp_extract(p, '([^/]*)$', 1), '.(\\.[^.]+)$', 1) AS ext,
regexp_extract(p, '([^/]+?)(\\.[^./]+)?/*$', 1) AS repo FROM (SELECT page_id, regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1) AS p FROM pages)""", tables=False)
def p20_path_parts(spark, d):
    p = F.regexp_extract("url", "^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1)
    return read_table(spark, d, "pages").select("page_id", T.basename(p).alias("base"), T.dirname(p).alias("dir"), T.extension(p).alias("ext"), T.repo_name(F.col("url")).alias("repo"))


def _count(part: str) -> str:
    return f"((length(content) - length(replace(content, '{part}', ''))) // {len(part)})"


@query(f"""SELECT id, round(least(len(string_split(content, chr(10))) / 10.0::DOUBLE, 2) + 0.5::DOUBLE * ({_count('if ')} + {_count('for ')} + {_count('while ')}) + 0.3::DOUBLE * ({_count('try:')} + {_count('except')})
+ least(list_max(list_transform(string_split(content, chr(10)), lambda x: CASE WHEN trim(x) <> '' THEN length(x) - length(ltrim(x)) ELSE 0 END)) / 4.0::DOUBLE, 2), 2) AS score FROM contents""")
def p24_heuristic_complexity(spark, d):
    return A.contents(spark, d).select("id", T.heuristic_complexity(F.col("content")).alias("score"))


@query("""SELECT id, 'name: ' || name || chr(10) || 'file: ' || file_path || chr(10) || 'class: ' || parent_class AS text, left(name || '::' || file_path || '::' || parent_class, 100) AS key FROM functions""")
def p35_embedding_text(spark, d):
    f = A.functions(spark, d)
    return f.select("id", T.embedding_text(name=F.col("name"), file=F.col("file_path"), **{"class": F.col("parent_class")}).alias("text"), T.unique_key(F.col("name"), F.col("file_path"), F.col("parent_class")).alias("key"))


@query("""WITH l AS (SELECT id, string_split(content, chr(10)) AS ls FROM contents WHERE contains(lower(content), 'license')), h AS (SELECT id, ls, list_filter(range(len(ls)), lambda i: contains(lower(ls[i + 1]), 'license'))[1:3] AS hits FROM l),
p AS (SELECT id, list_transform(hits, lambda i: array_to_string(ls[greatest(i - 3, 0) + 1:i + 4], chr(10))) AS ps FROM h)
SELECT id, array_to_string(list_transform(ps, lambda x: CASE WHEN length(x) > 200 THEN left(x, 200) || '...' ELSE x END), '|||') AS highlights FROM p""")
def p39_highlights(spark, d):
    c = A.contents(spark, d).filter(F.contains(F.lower("content"), F.lit("license")))
    return c.select("id", F.array_join(T.highlights(F.col("content"), "license"), "|||").alias("highlights"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2))), ' ') AS words FROM benchmark""", tables=False)
def p41_keywords(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.keywords(F.col("text"), [])), " ").alias("words"))


@query("""SELECT id, round((CASE WHEN contains(lower(filepath), 'src1') THEN 0.6 ELSE 0 END) + (CASE WHEN contains(lower(content), 'src1') THEN 0.4 ELSE 0 END), 6)::DOUBLE AS score FROM contents""")
def r22_keyword_score(spark, d):
    return A.contents(spark, d).select("id", F.round(T.keyword_score("src1", F.lit(""), F.col("filepath"), F.col("content"), F.lit("")), 6).alias("score"))


# --- scores and ranking

_LEVEL = "CASE WHEN score >= 20 THEN 'Critical' WHEN score >= 15 THEN 'High' WHEN score >= 10 THEN 'Medium' WHEN score >= 5 THEN 'Low' ELSE 'Minimal' END"
_TRAD = f"""{_REACH}, {_DEG}, far AS (SELECT src AS id, count(*) AS reachable, sum(log2(depth + 2.0::DOUBLE)) AS depth_impact FROM reach WHERE src <> dst GROUP BY 1),
x AS (SELECT f.id, f.complexity_score, out_degree AS o, in_degree AS i, coalesce(reachable, 0) AS reachable, coalesce(depth_impact, 0) AS di FROM functions f JOIN deg ON deg.id = f.id LEFT JOIN far ON far.id = f.id),
trad AS (SELECT id, o AS out_degree, i AS in_degree, reachable, round((o * 1.0::DOUBLE + reachable * 0.8::DOUBLE + di * 0.6::DOUBLE + (CASE WHEN o > 0 AND i > 0 THEN least(o, i) * 0.5::DOUBLE ELSE 0 END) * 1.2::DOUBLE + i * 0.7::DOUBLE
+ (CASE WHEN o <= 2 AND i >= 5 THEN i * 0.2::DOUBLE ELSE 0 END) + (CASE WHEN o >= 5 THEN o * 0.1::DOUBLE ELSE 0 END)) * (CASE WHEN complexity_score > 0 THEN 1 + log10(complexity_score + 1) * 0.3::DOUBLE ELSE 1 END), 2) AS score FROM x)"""


@query(f"WITH {_TRAD} SELECT *, {_LEVEL} AS importance_level FROM trad")
def r1_traditional_importance(spark, d):
    return ranking.traditional(A.functions(spark, d), _edges(spark, d))


_ROUNDS = 5
_PR = "outs AS (SELECT src, count(*) AS o FROM edges GROUP BY src), cnt AS (SELECT count(*)::DOUBLE AS n FROM functions), pr0 AS (SELECT id, 1 / n AS r FROM functions, cnt)" + "".join(
    f""", pr{k + 1} AS (SELECT f.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM pr{k} WHERE id NOT IN (SELECT src FROM outs)) / n + 0.85::DOUBLE * coalesce(g.got, 0) AS r FROM functions f CROSS JOIN cnt
LEFT JOIN (SELECT e.dst, sum(p.r / outs.o) AS got FROM edges e JOIN outs ON outs.src = e.src JOIN pr{k} p ON p.id = e.src GROUP BY e.dst) g ON g.dst = f.id)"""
    for k in range(_ROUNDS)
)


@query(f"WITH {_PR} SELECT id, round(r, 9) AS rank FROM pr{_ROUNDS}")
def r2_pagerank(spark, d):
    return ranking.pagerank(A.functions(spark, d), _edges(spark, d), rounds=_ROUNDS).withColumn("rank", F.round("rank", 9))


_CONVERGED = """cnt AS (SELECT count(*)::DOUBLE AS n FROM functions), outs AS (SELECT src, count(*)::DOUBLE AS o FROM edges GROUP BY src),
pr(i, id, r, moved) AS (SELECT 0, id, 1 / n, 1e9::DOUBLE FROM functions, cnt UNION ALL SELECT * FROM (SELECT i, id, r, sum(abs(r - was)) OVER () FROM (
  SELECT p.i + 1 AS i, p.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(q.r), 0) FROM pr q WHERE q.id NOT IN (SELECT src FROM outs)) / n + 0.85::DOUBLE * coalesce(g.got, 0) AS r, p.r AS was FROM pr p CROSS JOIN cnt
  LEFT JOIN (SELECT e.dst, sum(q.r / outs.o) AS got FROM pr q JOIN edges e ON e.src = q.id JOIN outs ON outs.src = q.id GROUP BY e.dst) g ON g.dst = p.id WHERE p.moved >= 1e-6 * n) s) x),
ranked AS (SELECT id, r FROM pr WHERE i = (SELECT max(i) FROM pr))"""


@query(f"WITH {_CONVERGED} SELECT id, round(r, 9) AS rank FROM ranked")
def r2_pagerank_converged(spark, d):
    return ranking.pagerank(A.functions(spark, d), _edges(spark, d)).withColumn("rank", F.round("rank", 9))


@query(f"WITH {_TRAD}, lv AS (SELECT {_LEVEL} AS importance_level FROM trad) SELECT l AS importance_level, (SELECT count(*) FROM lv WHERE importance_level = l) AS n FROM (SELECT unnest(['Critical', 'High', 'Medium', 'Low', 'Minimal']) AS l)")
def r4_level_distribution(spark, d):
    return ranking.distribution(ranking.traditional(A.functions(spark, d), _edges(spark, d)))


@query(f"WITH {_TRAD}, lv AS (SELECT *, {_LEVEL} AS importance_level FROM trad) SELECT importance_level, CAST(rnk AS INT) AS rnk, id, score FROM (SELECT *, row_number() OVER (PARTITION BY importance_level ORDER BY score DESC, id) AS rnk FROM lv) WHERE rnk <= 5")
def r6_best_per_level(spark, d):
    return ranking.trends(ranking.traditional(A.functions(spark, d), _edges(spark, d)))[1]


@query(f"""WITH {_TRAD}, lv AS (SELECT {_LEVEL} AS importance_level FROM trad) SELECT count(*) AS n, count(*) FILTER (WHERE importance_level = 'Critical') AS n_critical, count(*) FILTER (WHERE importance_level = 'High') AS n_high,
round(count(*) FILTER (WHERE importance_level = 'Critical') / count(*), 6) AS share_critical, round(count(*) FILTER (WHERE importance_level = 'High') / count(*), 6) AS share_high FROM lv""")
def r8_importance_summary(spark, d):
    return ranking.summary(ranking.traditional(A.functions(spark, d), _edges(spark, d)))


_BY_RANK = """byrank AS (SELECT f.id, f.complexity_score AS cs, round(r * CASE WHEN complexity_score > 0 THEN 1 + log10(complexity_score + 1) * 0.3::DOUBLE ELSE 1 END * 1000, 2) AS p FROM functions f JOIN ranked USING (id))"""
_HYBRID = """parts AS (SELECT id, trad.score AS t, p, round(CASE WHEN cs > 0 THEN 1 + log10(cs + 1) * 0.3::DOUBLE ELSE 1 END, 2) AS factor, max(trad.score) OVER () AS bt, max(p) OVER () AS bp FROM trad JOIN byrank USING (id)),
mixed AS (SELECT id, round(0.4::DOUBLE * (p / bp * 100) + 0.4::DOUBLE * (t / bt * 100) + 10.0::DOUBLE * (factor - 1), 2) AS score FROM parts)"""


@query(f"WITH {_TRAD}, {_CONVERGED}, {_BY_RANK}, {_HYBRID} SELECT id, score, {_LEVEL} AS importance_level FROM mixed")
def r3_hybrid_importance(spark, d):
    return ranking.hybrid(A.functions(spark, d), _edges(spark, d))


@query(f"""WITH {_TRAD}, {_CONVERGED}, {_BY_RANK}, a AS (SELECT id, score FROM trad ORDER BY score DESC, id LIMIT 20), b AS (SELECT id, p FROM byrank ORDER BY p DESC, id LIMIT 20)
SELECT count(*) AS n_common, CASE WHEN count(*) > 1 THEN round(corr(score, p), 3) END AS correlation FROM a JOIN b USING (id)""")
def r7_compare_scores(spark, d):
    f, e = A.functions(spark, d), _edges(spark, d)
    return ranking.compare(ranking.traditional(f, e), ranking.pagerank_importance(f, e))


_SCORE = "round(0.4::DOUBLE * cyclomatic_complexity + 0.01::DOUBLE * lines_of_code + 0.3::DOUBLE * branch_count + 0.1::DOUBLE * parameters, 6)"


@query(f"SELECT id, {_SCORE} AS score, CASE WHEN {_SCORE} < 10 THEN 'simple' WHEN {_SCORE} < 25 THEN 'moderate' ELSE 'complex' END AS level FROM functions")
def r9_complexity_score(spark, d):
    return complexity.scored(A.functions(spark, d))


_ADAPTIVE = """w AS (SELECT CASE WHEN max(cyclomatic_complexity) FILTER (WHERE cyclomatic_complexity > 0) - min(cyclomatic_complexity) FILTER (WHERE cyclomatic_complexity > 0) > 20 THEN 0.5::DOUBLE
  WHEN max(cyclomatic_complexity) FILTER (WHERE cyclomatic_complexity > 0) - min(cyclomatic_complexity) FILTER (WHERE cyclomatic_complexity > 0) > 10 THEN 0.4 ELSE 0.3 END AS c,
  CASE WHEN stddev_samp(lines_of_code) FILTER (WHERE lines_of_code > 0) > 50 THEN 0.02::DOUBLE WHEN stddev_samp(lines_of_code) FILTER (WHERE lines_of_code > 0) > 20 THEN 0.015 ELSE 0.01 END AS l,
  CASE WHEN stddev_samp(branch_count) FILTER (WHERE branch_count > 0) > 10 THEN 0.35::DOUBLE WHEN stddev_samp(branch_count) FILTER (WHERE branch_count > 0) > 5 THEN 0.3 ELSE 0.25 END AS b,
  CASE WHEN stddev_samp(parameters) FILTER (WHERE parameters > 0) > 5 THEN 0.15::DOUBLE WHEN stddev_samp(parameters) FILTER (WHERE parameters > 0) > 2 THEN 0.1 ELSE 0.05 END AS p FROM functions)"""


@query(f"""WITH {_ADAPTIVE}, s AS (SELECT id, round(cyclomatic_complexity * (c / (c + l + b + p)) + lines_of_code * (l / (c + l + b + p)) + branch_count * (b / (c + l + b + p)) + parameters * (p / (c + l + b + p)), 6) AS score, {_SCORE} AS fixed FROM functions, w),
q AS (SELECT list_sort(list(fixed)) AS f, count(*) AS n FROM s)
SELECT id, score, CASE WHEN score <= f[n // 4 + 1] THEN 'simple' WHEN score <= f[3 * n // 4 + 1] THEN 'moderate' ELSE 'complex' END AS level FROM s, q""")
def r10_adaptive_complexity(spark, d):
    return complexity.adaptive(A.functions(spark, d))


@query(f"WITH s AS (SELECT id, {_SCORE} AS score FROM functions) SELECT id, round(cume_dist() OVER (ORDER BY score) * 100, 6) AS percentile FROM s")
def r11_percentile_rank(spark, d):
    return complexity.percentile_rank(complexity.scored(A.functions(spark, d)))


@query(f"""WITH {_FAR}, g AS (SELECT dst AS id, count(*) AS k, sum(depth) AS total FROM r20 WHERE src <> dst GROUP BY dst)
SELECT f.id, coalesce(round(k / total * k / (SELECT count(*) - 1 FROM functions), 6), 0.0) AS closeness FROM functions f LEFT JOIN g ON g.id = f.id""")
def r13_closeness(spark, d):
    return centrality.closeness(A.functions(spark, d).select("id"), _edges(spark, d))


@query("""WITH ev(i, id, v, moved) AS (SELECT 0, id, 1.0::DOUBLE, 1e9::DOUBLE FROM functions UNION ALL SELECT * FROM (SELECT i, id, v, sum(abs(v - was)) OVER () FROM (
  SELECT i, id, raw / sqrt(sum(raw * raw) OVER ()) AS v, was FROM (SELECT p.i + 1 AS i, p.id, p.v + coalesce(g.got, 0) AS raw, p.v AS was FROM ev p
  LEFT JOIN (SELECT e.dst, sum(q.v) AS got FROM ev q JOIN edges e ON e.src = q.id GROUP BY e.dst) g ON g.dst = p.id WHERE p.moved >= 1e-6 * (SELECT count(*) FROM functions) AND p.i < 1000) s) u) x)
SELECT id, round(v, 6) AS centrality FROM ev WHERE i = (SELECT max(i) FROM ev)""")
def r13_eigenvector(spark, d):
    return centrality.eigenvector(A.functions(spark, d).select("id"), _edges(spark, d), 1000)


_LEVELS = 60  # more than the longest shortest path of the tables


def _betweenness() -> str:
    parts = ["l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS paths FROM functions), k0 AS MATERIALIZED (SELECT s, v FROM l0)"]
    for k in range(1, _LEVELS + 1):
        parts.append(f"l{k} AS MATERIALIZED (SELECT a.s, e.dst AS v, sum(a.paths) AS paths FROM l{k - 1} a JOIN edges e ON e.src = a.v ANTI JOIN k{k - 1} r ON r.s = a.s AND r.v = e.dst GROUP BY a.s, e.dst)")
        parts.append(f"k{k} AS MATERIALIZED (SELECT * FROM k{k - 1} UNION ALL SELECT s, v FROM l{k})")
    parts.append(f"h{_LEVELS} AS MATERIALIZED (SELECT s, v, paths, 0.0::DOUBLE AS share FROM l{_LEVELS})")
    for k in reversed(range(_LEVELS)):
        parts.append(f"h{k} AS MATERIALIZED (SELECT l.s, l.v, l.paths, l.paths * coalesce(sum((1 + h.share) / h.paths), 0) AS share FROM l{k} l LEFT JOIN edges e ON e.src = l.v LEFT JOIN h{k + 1} h ON h.s = l.s AND h.v = e.dst GROUP BY l.s, l.v, l.paths)")
    every = " UNION ALL ".join(f"SELECT v, share FROM h{k} WHERE s <> v" for k in range(1, _LEVELS + 1))
    return f"WITH {', '.join(parts)} SELECT f.id, round(coalesce(sum(share), 0), 6) AS betweenness FROM functions f LEFT JOIN ({every}) t ON t.v = f.id GROUP BY f.id"


@query(_betweenness())
def r13_betweenness(spark, d):
    return centrality.betweenness(A.functions(spark, d).select("id"), _edges(spark, d), max_depth=None)


@query(f"WITH {_DEG} SELECT id, in_degree + out_degree AS degree FROM deg ORDER BY degree DESC, id LIMIT 20")
def r14_degree_centrality(spark, d):
    return G.degrees(A.functions(spark, d), _edges(spark, d)).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).orderBy(F.desc("degree"), "id").limit(20)


_BOTH = "both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@query(f"""WITH {_BOTH}, lp(i, id, c, moved) AS (SELECT 0, id, id, 1::BIGINT FROM functions UNION ALL SELECT i, id, c, moved FROM (SELECT p.i + 1 AS i, p.id, v.c, count(*) FILTER (WHERE v.c <> p.c) OVER () AS moved FROM lp p JOIN (
  SELECT id, min(struct_pack(n := -n, c := c)).c AS c FROM (SELECT id, c, count(*) AS n FROM (SELECT b.dst AS id, q.c FROM lp q JOIN both_ways b ON b.src = q.id UNION ALL SELECT id, c FROM lp) GROUP BY id, c) GROUP BY id) v ON v.id = p.id
  WHERE p.moved > 0 AND p.i < 100) s) SELECT id, c AS community FROM lp WHERE i = (SELECT max(i) FROM lp)""")
def r15_label_propagation(spark, d):
    return centrality.label_propagation(A.functions(spark, d).select("id"), _edges(spark, d), 100)


@query(f"""WITH {_BOTH}, tw AS (SELECT count(*)::DOUBLE AS m FROM both_ways), deg AS MATERIALIZED (SELECT f.id, count(b.src) AS k FROM functions f LEFT JOIN both_ways b ON b.src = f.id GROUP BY f.id),
lv(i, id, c, moved) AS (SELECT 0, id, id, 1::BIGINT FROM functions UNION ALL SELECT i, id, c, moved FROM (SELECT p.i + 1 AS i, p.id, coalesce(x.next, p.c) AS c, count(x.next) OVER () AS moved FROM lv p LEFT JOIN (
  SELECT id, min(struct_pack(g := -gain, c := c)).c AS next FROM (SELECT o.*, coalesce(max(CASE WHEN c = was THEN w - (total - k) * k / m END) OVER (PARTITION BY id), 0.0) AS stay FROM (
    SELECT l.id, l.c, l.w, t.total, d.k, own.c AS was, m, l.w - t.total * d.k / m AS gain FROM (SELECT b.src AS id, q.c, count(*) AS w FROM both_ways b JOIN lv q ON q.id = b.dst GROUP BY b.src, q.c) l
    JOIN (SELECT q.c, sum(d2.k) AS total FROM lv q JOIN deg d2 ON d2.id = q.id GROUP BY q.c) t ON t.c = l.c JOIN deg d ON d.id = l.id JOIN lv own ON own.id = l.id CROSS JOIN tw) o) o2
  WHERE c < was AND gain > stay + 1e-12 GROUP BY id) x ON x.id = p.id WHERE p.moved > 0 AND p.i < 100) s) SELECT id, c AS community FROM lv WHERE i = (SELECT max(i) FROM lv)""")
def r15_louvain_level(spark, d):
    return centrality.louvain_level(A.functions(spark, d).select("id"), _edges(spark, d), 100)


@query("""WITH ctx AS (SELECT f.id, CAST(f.id AS VARCHAR) AS name, f.cyclomatic_complexity::DOUBLE AS cc, coalesce((SELECT list(DISTINCT g.name) FROM edges e JOIN functions g ON g.id = e.dst WHERE e.src = f.id), []) AS callees,
coalesce((SELECT list(DISTINCT g.name) FROM edges e JOIN functions g ON g.id = e.src WHERE e.dst = f.id), []) AS callers FROM functions f WHERE f.id BETWEEN 1 AND 12), n AS (SELECT unnest(['1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12', 'unknown']) AS name)
SELECT x.name AS a, y.name AS b, CASE WHEN x.name = y.name THEN 1.0::DOUBLE ELSE coalesce(round((CASE WHEN len(list_distinct(p.callees || q.callees)) = 0 THEN 0 ELSE len(list_intersect(p.callees, q.callees)) / len(list_distinct(p.callees || q.callees)) END
+ CASE WHEN len(list_distinct(p.callers || q.callers)) = 0 THEN 0 ELSE len(list_intersect(p.callers, q.callers)) / len(list_distinct(p.callers || q.callers)) END + 1 - abs(p.cc - q.cc) / greatest(p.cc, q.cc, 1)) / 3, 6), 0.0) END AS similarity
FROM n x CROSS JOIN n y LEFT JOIN ctx p ON p.name = x.name LEFT JOIN ctx q ON q.name = y.name""")
def r16_structural_similarity(spark, d):
    c = G.function_context(A.functions(spark, d), _edges(spark, d)).join(A.functions(spark, d).select("id", F.col("cyclomatic_complexity").cast("double").alias("complexity")), "id")
    c = c.withColumn("name", F.col("id").cast("string"))
    return hybrid.structural_similarity(c, [str(i) for i in range(1, 13)] + ["unknown"])


# --- vectors


@query(f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rnk FROM cos WHERE score >= 0.3 ORDER BY score DESC, vec_id LIMIT 10")
def v3_top_k(spark, d):
    e = read_table(spark, d, "embeddings")
    return vectors.top_k(e, vectors.vector_of(e, 0), 10, threshold=0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH {_VEC}, l2 AS (SELECT v.vec_id, list_distance(v.e, q.e) AS score FROM v, q) SELECT vec_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score, vec_id) AS INT) AS rnk FROM l2 ORDER BY score, vec_id LIMIT 10""")
def v4_top_k_by_distance(spark, d):
    e = read_table(spark, d, "embeddings")
    return vectors.top_k(e, vectors.vector_of(e, 0), 10, "l2").withColumn("score", F.round("score", 6))


@query()
def v5_cell_search(spark, d):
    e = read_table(spark, d, "embeddings")
    return vectors.cell_search(e, vectors.vector_of(e, 0), 10, 16, 8)


@query(f"WITH {_VEC} SELECT vec_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rnk FROM cos WHERE vec_id <> 0 AND score >= 0.3 ORDER BY score DESC, vec_id LIMIT 5")
def v12_recommendations(spark, d):
    e = read_table(spark, d, "embeddings")
    return vectors.top_k(e, vectors.vector_of(e, 0), 5, threshold=0.3, exclude=0).withColumn("score", F.round("score", 6))


@query("""WITH p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45),
st(i, id, s, open) AS (SELECT 0, id, 0, 1::BIGINT FROM (SELECT a AS id FROM p UNION SELECT b FROM p) UNION ALL SELECT i, id, s, open FROM (SELECT i, id, s, count(*) FILTER (WHERE s = 0) OVER () AS open FROM (
  SELECT t.i + 1 AS i, t.id, CASE WHEN t.s <> 0 THEN t.s WHEN t.i % 2 = 0 AND w.b IS NULL THEN 1 WHEN t.i % 2 = 1 AND l.b IS NOT NULL THEN 2 ELSE 0 END AS s FROM st t
  LEFT JOIN (SELECT DISTINCT p.b FROM p JOIN st x ON x.id = p.a AND x.s = 0) w ON w.b = t.id LEFT JOIN (SELECT DISTINCT p.b FROM p JOIN st x ON x.id = p.a AND x.s = 1) l ON l.b = t.id WHERE t.open > 0) u) z)
SELECT p.a AS leader, p.b AS member, round(score, 6) AS score FROM p JOIN st ON st.id = p.a AND st.s = 1 AND st.i = (SELECT max(i) FROM st)""", tables=False)
def v14_leader_groups(spark, d):
    return vectors.leader_groups(vectors.similar_pairs(read_table(spark, d, "embeddings"), 0.45)).withColumn("score", F.round("score", 6))


@query()
def v15_kmeans(spark, d):
    return vectors.kmeans(read_table(spark, d, "embeddings"), 10)


@query("SELECT DISTINCT name FROM functions WHERE contains(lower(name), 're') ORDER BY length(name), name LIMIT 10")
def v16_suggestions(spark, d):
    return A.functions(spark, d).filter(F.contains(F.lower("name"), F.lit("re"))).select("name").distinct().orderBy(F.length("name"), "name").limit(10)


@query("SELECT id, query, CAST(rnk AS INT) AS rnk FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rnk FROM history) WHERE rnk <= 100")
def v17_recent_history(spark, d):
    return G.top(A.history(spark, d).select("id", "query", "ts"), 100, F.desc("ts"), F.desc("id")).select("id", "query", "rnk")


# --- streams


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total_value FROM events GROUP BY 1, 2""", tables=False)
def st1_windowed_counts(spark, d):
    from graphloom.streaming import history as H

    events = H.read_history(spark, d, read_table(spark, d, "events").schema, "events.parquet")
    out = H.run_to_table(H.windowed_counts(events))  # the complete mode keeps every window, so nothing is late
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total_value", 4).alias("total_value"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""", tables=False)
def st2_sessions(spark, d):
    from graphloom.streaming import history as H

    events = H.read_history(spark, d, read_table(spark, d, "events").schema, "events.parquet")
    s = H.run_to_table(H.sessions(events))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


# --- several operators in one


@query(f"""WITH {_REACH}, {_CONVERGED}, {_BOTH}, lp(i, id, c, moved) AS (SELECT 0, id, id, 1::BIGINT FROM functions UNION ALL SELECT i, id, c, moved FROM (SELECT p.i + 1 AS i, p.id, v.c, count(*) FILTER (WHERE v.c <> p.c) OVER () AS moved FROM lp p JOIN (
  SELECT id, min(struct_pack(n := -n, c := c)).c AS c FROM (SELECT id, c, count(*) AS n FROM (SELECT b.dst AS id, q.c FROM lp q JOIN both_ways b ON b.src = q.id UNION ALL SELECT id, c FROM lp) GROUP BY id, c) GROUP BY id) v ON v.id = p.id
  WHERE p.moved > 0 AND p.i < 100) s), labels AS (SELECT id, c FROM lp WHERE i = (SELECT max(i) FROM lp)), chosen AS (SELECT id, name FROM functions ORDER BY id LIMIT 1),
best AS (SELECT id, row_number() OVER (ORDER BY r DESC, id) AS rank FROM ranked)
SELECT x.id, x.name, coalesce((SELECT CAST(rank AS INT) FROM best WHERE best.id = x.id AND rank <= 100), 0) AS rank, (SELECT count(*) FROM functions) AS n_functions, l.c AS community, (SELECT count(*) FROM labels k WHERE k.c = l.c) AS community_size,
(SELECT count(*) FROM reach WHERE src = x.id AND dst <> x.id) AS n_dependencies, (SELECT count(*) FROM reach WHERE src = x.id AND dst <> x.id AND depth = 1) AS n_direct FROM chosen x JOIN labels l ON l.id = x.id""")
def r23_importance_profile(spark, d):
    f = A.functions(spark, d)
    return profile.importance_profile(f, _edges(spark, d), f.orderBy("id").first()["name"]).fillna(0, ["rank"])  # 0: not among the best


@query()
def v10_hybrid_search(spark, d):
    from graphloom.functions.embed import embed, embedder
    from graphloom.plans.search import Searcher, SearchRequest
    from graphloom.session import materialize

    rows = A.contents(spark, d).filter("content is not null")
    model = embedder(1024).fit(rows)
    table = materialize(embed(model, rows), "embedded")
    vector = lambda q: list(embed(model, spark.createDataFrame([(q,)], "content string")).first()["embedding"])
    return Searcher(table, vector, sparse=True).search(SearchRequest("license", threshold=0.05)).withColumn("highlights", F.array_join("highlights", "|||"))
