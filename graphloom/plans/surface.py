"""Registered queries of the remaining searches, joins and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import adapters as A
from graphloom.functions import parse as P
from graphloom.functions import text as T
from graphloom.operators import callgraph as G
from graphloom.operators import centrality, filters, hybrid, ranking, vectors
from graphloom.plans.registry import query
from graphloom.plans.search import Searcher, SearchRequest
from graphloom.session import read_table
from graphloom.sources import files


def _edges(spark, d):
    return G.distinct_edges(A.calls(spark, d))


@query("SELECT id, name, complexity_score FROM functions WHERE contains(name, 're') ORDER BY complexity_score DESC, id LIMIT 20")
def f3_by_name_ranked(spark, d):
    return filters.ranked(A.functions(spark, d), F.contains("name", F.lit("re"))).select("id", "name", "complexity_score")


_KIND = "CASE WHEN contains(lower(content), 'test') THEN 'test' WHEN contains(content, 'async') OR contains(content, 'await') THEN 'async' WHEN contains(content, '@') AND contains(content, 'def') THEN 'decorator' WHEN contains(content, 'class') AND contains(content, 'def') THEN 'method' ELSE 'regular' END"


@query(f"SELECT id, {_KIND} AS function_type, CAST(length(content) AS BIGINT) AS size FROM contents WHERE {_KIND} = 'regular' ORDER BY size DESC, id LIMIT 20")
def f6_by_type(spark, d):
    c = A.contents(spark, d).select("id", T.content_type(F.col("content"), F.col("content")).alias("function_type"), F.length("content").cast("long").alias("size"))
    return filters.ranked(c, F.col("function_type") == "regular", "size")


@query("SELECT id, name, lines_of_code FROM functions WHERE contains(lower(name), 'steel') OR contains(lower(file_path), 'steel') OR contains(lower(name), 'red') OR contains(lower(file_path), 'red') ORDER BY lines_of_code DESC, id LIMIT 20")
def f9_keyword_fallback(spark, d):
    hits = filters.any_keyword(A.functions(spark, d), ["steel", "red"], ["name", "file_path"])
    return hits.orderBy(F.desc("lines_of_code"), "id").limit(20).select("id", "name", "lines_of_code")


@query("""WITH m AS (SELECT id, split_part(file_path, ' ', 1) AS module FROM functions) SELECT a.module AS from_group, b.module AS to_group, count(*) AS n_calls FROM calls c JOIN m a ON a.id = c.src JOIN m b ON b.id = c.dst WHERE a.module <> b.module GROUP BY 1, 2""")
def g2_module_dependencies(spark, d):
    f = A.functions(spark, d).withColumn("module", F.split("file_path", " ")[0])
    return G.grouped_dependencies(f, A.calls(spark, d), "module")


@query("""WITH w AS (SELECT id, unnest(string_split(name, ' ')) AS callee FROM functions), o AS (SELECT DISTINCT f.file_path, w.callee FROM w JOIN functions f USING (id) WHERE w.callee NOT IN (SELECT name FROM functions))
SELECT file_path AS "group", string_agg(callee, ',' ORDER BY callee) AS names, count(*) AS n FROM o GROUP BY 1""")
def g2_external_calls(spark, d):
    f = A.functions(spark, d)
    calls = f.select("id", F.explode(F.split("name", " ")).alias("callee"))
    return G.external_calls(f, calls).withColumn("names", F.array_join("names", ","))


_CHAINS = """c1 AS (SELECT src, dst, 1 AS depth, [src, dst] AS nodes FROM edges), c2 AS (SELECT a.src, e.dst, 2 AS depth, min(list_append(a.nodes, e.dst)) AS nodes FROM c1 a JOIN edges e ON e.src = a.dst ANTI JOIN c1 k ON k.src = a.src AND k.dst = e.dst WHERE a.src <> e.dst GROUP BY a.src, e.dst),
c3 AS (SELECT a.src, e.dst, 3 AS depth, min(list_append(a.nodes, e.dst)) AS nodes FROM c2 a JOIN edges e ON e.src = a.dst ANTI JOIN (SELECT src, dst FROM c1 UNION ALL SELECT src, dst FROM c2) k ON k.src = a.src AND k.dst = e.dst WHERE a.src <> e.dst GROUP BY a.src, e.dst)"""


@query(f"WITH {_CHAINS} SELECT src, dst, depth, array_to_string(nodes, '>') AS chain FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) ORDER BY depth DESC, src, dst LIMIT 10")
def g4_longest_chains(spark, d):
    chains = G.shortest_chains(_edges(spark, d), 3).orderBy(F.desc("depth"), "src", "dst").limit(10)
    return chains.select("src", "dst", "depth", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("chain"))


@query("""SELECT DISTINCT src, dst FROM (SELECT a.src, a.dst FROM edges a WHERE a.dst = 1 UNION ALL SELECT b.src, b.dst FROM edges a JOIN edges b ON b.dst = a.src WHERE a.dst = 1
UNION ALL SELECT a.src, a.dst FROM edges a WHERE a.src = 1 UNION ALL SELECT b.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 1)""")
def g29_call_graph_both_ways(spark, d):
    return G.graph_around(_edges(spark, d), spark.createDataFrame([(1,)], "id long"), 2, "both")


@query("SELECT DISTINCT c.file_path, f.id, f.name FROM functions f JOIN functions c ON c.file_path = f.file_path WHERE f.parent_class IS NOT NULL")
def j9_file_functions(spark, d):
    f = A.functions(spark, d)
    return f.select("file_path").distinct().join(f.filter("parent_class is not null").select("file_path", "id", "name"), "file_path")


@query("""SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), md5(CAST(d.doc_id AS VARCHAR))) AS value, l.doc_id IS NULL AS fresh FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""", tables=False)
def j17_with_cache(spark, d):
    cache = read_table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("value")).withColumn("fresh", F.lit(False))
    wanted = read_table(spark, d, "documents").select("doc_id").distinct()
    done, _ = hybrid.with_cache(wanted, cache, "doc_id", lambda missing: missing.select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("value"), F.lit(True).alias("fresh")))
    return done.select("doc_id", F.coalesce("value", F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("value"), "fresh")


@query("SELECT count(*) AS n_before, count(*) FILTER (WHERE lines_of_code > 40) AS n_after FROM functions")
def p15_large_function_counts(spark, d):
    return P.large_function_counts(A.functions(spark, d), 40)


_WEIGHTED = """we AS (SELECT e.src, e.dst, CASE WHEN a.file_path = b.file_path THEN 1.0::DOUBLE ELSE 0.5 END AS w FROM edges e JOIN functions a ON a.id = e.src JOIN functions b ON b.id = e.dst), outs AS (SELECT src, sum(w) AS o FROM we GROUP BY src), cnt AS (SELECT count(*)::DOUBLE AS n FROM functions),
pr(i, id, r, moved) AS (SELECT 0, id, 1 / n, 1e9::DOUBLE FROM functions, cnt UNION ALL SELECT * FROM (SELECT i, id, r, sum(abs(r - was)) OVER () FROM (
  SELECT p.i + 1 AS i, p.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(q.r), 0) FROM pr q WHERE q.id NOT IN (SELECT src FROM outs)) / n + 0.85::DOUBLE * coalesce(g.got, 0) AS r, p.r AS was FROM pr p CROSS JOIN cnt
  LEFT JOIN (SELECT e.dst, sum(q.r * e.w / outs.o) AS got FROM pr q JOIN we e ON e.src = q.id JOIN outs ON outs.src = q.id GROUP BY e.dst) g ON g.dst = p.id WHERE p.moved >= 1e-6 * n) s) x)"""


@query(f"WITH {_WEIGHTED} SELECT id, round(r, 9) AS rank FROM pr WHERE i = (SELECT max(i) FROM pr) ORDER BY r DESC, id LIMIT 20")
def r13_weighted_pagerank(spark, d):
    f = A.functions(spark, d)
    a, b = f.select(F.col("id").alias("src"), F.col("file_path").alias("a")), f.select(F.col("id").alias("dst"), F.col("file_path").alias("b"))
    e = _edges(spark, d).join(a, "src").join(b, "dst").withColumn("weight", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.5))
    ranks = ranking.pagerank(f.select("id"), e, weight="weight")
    return ranks.orderBy(F.desc("rank"), "id").limit(20).select("id", F.round("rank", 9).alias("rank"))


@query("""WITH both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), lp(i, id, c, moved) AS (SELECT 0, id, id, 1::BIGINT FROM functions UNION ALL SELECT i, id, c, moved FROM (SELECT p.i + 1 AS i, p.id, v.c, count(*) FILTER (WHERE v.c <> p.c) OVER () AS moved FROM lp p JOIN (
  SELECT id, min(struct_pack(n := -n, c := c)).c AS c FROM (SELECT id, c, count(*) AS n FROM (SELECT b.dst AS id, q.c FROM lp q JOIN both_ways b ON b.src = q.id UNION ALL SELECT id, c FROM lp) GROUP BY id, c) GROUP BY id) v ON v.id = p.id
  WHERE p.moved > 0 AND p.i < 100) s) SELECT c AS community, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, c) AS INT) AS rnk FROM lp WHERE i = (SELECT max(i) FROM lp) GROUP BY c HAVING count(*) >= 2""")
def r15_communities(spark, d):
    return centrality.communities(centrality.label_propagation(A.functions(spark, d).select("id"), _edges(spark, d), 100))


@query("""WITH ctx AS (SELECT CAST(f.id AS VARCHAR) AS name, coalesce((SELECT list(DISTINCT g.name) FROM edges e JOIN functions g ON g.id = e.dst WHERE e.src = f.id), []) AS callees FROM functions f WHERE f.id BETWEEN 1 AND 12), n AS (SELECT unnest(['1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12', 'unknown']) AS name)
SELECT x.name AS a, y.name AS b, CASE WHEN x.name = y.name THEN 1.0::DOUBLE ELSE coalesce(round(CASE WHEN len(list_distinct(p.callees || q.callees)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(p.callees, q.callees)) / len(list_distinct(p.callees || q.callees)) END, 6), 0.0) END AS similarity
FROM n x CROSS JOIN n y LEFT JOIN ctx p ON p.name = x.name LEFT JOIN ctx q ON q.name = y.name""")
def r17_callee_similarity(spark, d):
    c = G.function_context(A.functions(spark, d), _edges(spark, d)).withColumn("name", F.col("id").cast("string"))
    return hybrid.callee_similarity(c, [str(i) for i in range(1, 13)] + ["unknown"])


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id BETWEEN 0 AND 9 AND b.vec_id BETWEEN 0 AND 9""", tables=False)
def r18_semantic_matrix(spark, d):
    return vectors.similarity_matrix(read_table(spark, d, "embeddings"), list(range(10))).withColumn("score", F.round("score", 6))


@query("""SELECT id AS path, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS content_hash FROM contents ORDER BY length(content) DESC, id LIMIT 50""")
def s11_indexed_files(spark, d):
    # the size stands for the time of indexing
    c = A.contents(spark, d)
    index = c.select(F.col("id").alias("path"), F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_hash"), F.length("content").alias("indexed_at"))
    return files.indexed_files(index, 50).select("path", "n_chars", "content_hash")


@query("""WITH s AS (SELECT id, filepath, language, 0.6::DOUBLE * CAST(contains(lower(filepath), 'license') AS INT) + 0.4::DOUBLE * CAST(contains(lower(content), 'license') AS INT) AS score FROM contents)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rnk, filepath, language FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10""")
def v9_keyword_search(spark, d):
    table = A.contents(spark, d).withColumn("embedding", F.lit(None).cast("array<double>"))
    return Searcher(table).search(SearchRequest("license", "keyword")).select("id", "score", "rnk", "filepath", "language")


@query("""WITH w AS (SELECT regexp_replace(unnest(regexp_split_to_array(coalesce(content, ''), '\\s+')), '^[.,!?;:]+|[.,!?;:]+$', '', 'g') AS text FROM contents), e AS (SELECT name AS text FROM functions UNION ALL SELECT text FROM w WHERE length(text) > 2 UNION ALL SELECT query FROM history)
SELECT DISTINCT text, length(text) AS n FROM e WHERE contains(lower(text), 're') ORDER BY n, text LIMIT 10""".replace("\\\\", "\\"))
def v16_all_suggestions(spark, d):
    found = Searcher.suggest("re", A.functions(spark, d), A.contents(spark, d).withColumnRenamed("content", "docstring"), A.history(spark, d))
    return found.select("text", F.length("text").cast("long").alias("n"))
