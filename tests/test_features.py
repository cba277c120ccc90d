import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.functions import arrays, braces, structure
from graphloom.functions import context as C
from graphloom.functions import parse as P
from graphloom.operators import hybrid, relations, vectors
from graphloom.operators.index import VectorIndex
from graphloom.operators.ranges import running_total
from graphloom.plans import profile
from graphloom.session import shared_path
from graphloom.sources import files, graph, repositories

JAVA = """package a;
import java.util.List;
/** Doc. */
public class Shop extends Base implements Closeable {
  // counts things
  @Override
  public int count(List<String> names, int most) throws Error {
    String s = "{ not a brace }"; // trailing
    for (String n : names) { if (n != null && most > 0) { add(n, most(1, 2)); } }
    return 1;
  }
  Shop() { super(); }
}
"""
SCRIPT = """import { x } from './lib';
const fs = require('fs');
/* says hello */
async function hello(name, greeting = "hi") { return say(`${name}`, greeting); }
const add = (a, b) => { return a + b; };
window.onload = function () { start(); };
class Cart extends Base { total(rate) { if (rate) { return this.sum(rate); } } }
Cart.prototype.clear = function() { };
"""
GO = "package main\nimport \"fmt\"\nfunc (s *Server) Run(port int, host string) error {\n\tfor i := 0; i < port; i++ {\n\t\tfmt.Println(i)\n\t}\n\treturn nil\n}\n"
C_CODE = "#include <stdio.h>\nstatic int *find(const char *name, int n) {\n  while (n > 0) { n--; }\n  return lookup(name);\n}\nint Shop::size(void) const { return 0; }\n"


def test_braced_languages():
    functions, classes = braces.parse("Shop.java", JAVA, "java")
    count, shop = functions
    assert (count["name"], count["parent_class"], count["start_line"], count["end_line"], count["return_type"]) == ("count", "Shop", 6, 11, "int")
    assert count["parameters"] == [{"name": "names", "type": "List<String>", "default": None}, {"name": "most", "type": "int", "default": None}]
    assert [c["name"] for c in count["calls"]] == ["add", "most"] and count["calls"][0]["full_call"] == "add(n, most(1, 2))"
    assert (count["cyclomatic_complexity"], count["branch_count"], count["decorators"]) == (4, 2, ["Override"])
    assert count["comments"] == ["// counts things", "// trailing"] and shop["name"] == "Shop"
    assert [(c["class_name"], c["methods"], c["bases"]) for c in classes] == [("Shop", ["count", "Shop"], ["Base", "Closeable"])]
    functions, classes = braces.parse("a.js", SCRIPT, "javascript")
    assert [f["name"] for f in functions] == ["hello", "add", "window.onload", "total", "clear"]
    assert functions[0]["is_async"] and functions[0]["comments"] == ["/* says hello */"] and functions[0]["imports"] == ["./lib", "fs"]
    assert functions[0]["parameters"][1] == {"name": "greeting", "type": None, "default": '"hi"'}
    assert functions[3]["parent_class"] == "Cart" and functions[3]["calls"][0]["name"] == "sum"
    run = braces.parse("a.go", GO, "go")[0][0]
    assert (run["name"], run["parent_class"], run["return_type"], run["cyclomatic_complexity"]) == ("Run", "Server", "error", 2)
    assert [p["type"] for p in run["parameters"]] == ["int", "string"]
    find, size = braces.parse("a.cpp", C_CODE, "cpp")[0]
    assert (find["name"], find["parameters"][0]["name"], find["imports"]) == ("find", "name", ["stdio.h"])
    assert (size["name"], size["parent_class"], size["parameters"]) == ("size", "Shop", [])
    assert braces.parse("a.c", "int f( {{{ ) } \" ' /*", "c") is not None


def test_all_languages_in_one_table(spark):
    rows = [("/r/Shop.java", JAVA), ("/r/a.js", SCRIPT), ("/r/a.py", "# above\ndef f(x):\n    # inside\n    return g(x)\n"), ("/r/x.txt", "def no(): pass"), ("/r/n.js", None)]
    found = P.functions_of(spark.createDataFrame(rows, "path string, content string"))
    got = {r.name: r for r in found.collect()}
    assert set(got) == {"count", "Shop", "hello", "add", "total", "clear", "f"}  # no member of window
    assert got["f"].comments == ["# above", "# inside"]
    assert P.large_function_counts(found, 5).first().asDict() == {"n_before": 7, "n_after": 1}


def test_structure_by_patterns(spark):
    text = "import os\nfrom a import b, c\nclass A(B):\n  def f(self,\n    x):\n    pass\ndef g() -> int:\n"
    script = "function f() {}\nconst g = async (x) => x\nclass K {}"
    df = spark.createDataFrame([(text, "python"), (script, "javascript"), (text, "go"), (None, "python")], "c string, l string")
    py, js, other, none = [r[0] for r in df.select(structure.structure(F.col("c"), F.col("l"))).collect()]
    assert [(x.name, x.line) for x in py.functions] == [("f", 4)] and [(x.name, x.line) for x in py.classes] == [("A", 3)] and py.imports == ["os", "b, c"]
    assert [(x.name, x.line) for x in js.functions] == [("f", 1), ("g", 2)] and [(x.name, x.line) for x in js.classes] == [("K", 3)]
    assert other.functions == other.imports == none.classes == []
    names = spark.createDataFrame([("window.x",), ("self[a]",), ("a.b.c",), ("$x",), ("$",), ("f",), ("a['k']",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(structure.no_script_function(F.col("n"))).collect()] == [True, True, True, True, False, False, True, True, True]


def test_running_over_arrays(spark):
    df = spark.createDataFrame([([],), ([3],), (list(range(50)),)], "a array<int>")
    got = [r[0] for r in df.select(arrays.running(F.col("a"), F.lit(0), lambda a, b: a + b)).collect()]
    assert got == [[], [0], [sum(range(i)) for i in range(50)]]


def test_running_total(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "id % 7 AS v")
    got = running_total(df, [F.col("k")], F.col("v"), "upto").orderBy("k").collect()
    upto = 0
    for r in got:
        upto += r.v
        assert r.upto == upto
    assert running_total(df.limit(0), [F.col("k")], F.col("v"), "upto").count() == 0


def test_context_summaries(spark):
    path, cls, imports, calls = F.lit("/a/b.py"), F.lit("K"), F.array(F.lit("os"), F.lit("transformers"), F.lit("x")), F.array(F.lit("get_x"), F.lit("y"))
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        C.fast_summary(path, cls, imports).alias("a"), C.fast_summary(F.lit(None).cast("string"), F.lit(None).cast("string"), none).alias("b"), C.fallback_summary(path, F.lit(""), imports, F.lit(2)).alias("c"),
        C.model_purpose(F.lit("init_client"), F.lit("token = 1"), imports).alias("d"), C.domain_purpose(F.array(F.lit("requests")), none, F.lit("post_it")).alias("e"),
        C.domain_purpose(F.array(F.lit("numpy"), F.lit("pandas")), none, F.lit("f")).alias("f"), C.domain_purpose(none, none, F.lit("f")).alias("g"), C.call_pattern(calls).alias("h"),
        C.call_pattern(F.array(*map(F.lit, "pqrs"))).alias("i"), C.usage_breadth(F.lit(5)).alias("j"), C.config_kinds(F.array(F.lit("constant_definition"), F.lit("config_item"))).alias("k"),
        C.full_summary(path, cls, F.lit("load_it"), F.lit(""), imports, calls, F.lit(1)).alias("l"),
    ).first()
    assert (row.a, row.b, row.c) == ("文件: b.py | 类: K | 导入: os, transformers", "独立函数", "文件: b.py | 导入: os, transformers, x | 调用: 2个函数")
    assert (row.d, row.e, row.f, row.g) == ("用途: 配置AI模型服务连接", "用途: API数据交互", "用途: 数值计算, 数据分析", None)
    assert (row.h, row.i, row.j, row.k) == ("调用: 数据获取", "调用: 4个函数（复杂调用）", "使用: 5个文件调用（广泛使用）", "配置: 配置项, 常量")
    assert row.l == "文件: b.py | 类: K | 用途: 加载预训练模型 | 调用: 数据获取 | 使用: 单文件内调用"


def test_calls_by_content_in_blocks(spark, monkeypatch):
    rows = [(1, "load", "a.py", "def load(): pass"), (2, "save", "a.py", "load(); reload()"), (3, "x", "b.py", "load save"), (4, "y", "save/y.py", "x"), (5, None, "a.py", None), (6, "", "a.py", "load")]
    df = spark.createDataFrame(rows, "id long, name string, file_path string, content string")
    want = {(2, 1), (6, 1)}
    assert {(r.src, r.dst) for r in relations.calls_by_content(df).collect()} == want
    monkeypatch.setattr(relations, "NAMES", 1)
    assert {(r.src, r.dst) for r in relations.calls_by_content(df).collect()} == want


def test_descriptions_and_scores(spark):
    f = spark.createDataFrame([(1, "f", "x/a.py", "K"), (2, "f", "x/a.py", None), (3, "g", "b.py", None)], "id long, name string, file_path string, parent_class string")
    told = spark.createDataFrame([("f", "a", "K", "d1", "simple", "s", None), ("f", "a", None, "d2", None, None, "late")], "name string, stem string, parent_class string, description string, level string, summary string, error string")
    got = {r.id: (r.description, r.level, r.summary, r.has_error) for r in relations.described(f, told).collect()}
    assert got == {1: ("d1", "simple", "s", False), 2: ("d2", "unknown", "", True), 3: (None, "unknown", "", False)}
    scores = spark.createDataFrame([(1, 7.0, "Low")], "id long, score double, importance_level string")
    assert {(r.id, r.importance_score, r.importance_level) for r in relations.with_scores(f, scores).collect()} == {(1, 7.0, "Low"), (2, 0.0, "Minimal"), (3, 0.0, "Minimal")}
    assert [r.id for r in relations.class_methods(f, "K").collect()] == [1]


def test_vector_index(spark):
    index = VectorIndex(spark, shared_path(spark, "index"))
    assert index.load() is None
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", 1), (2, [0.0, 1.0], "b", 1)], "vec_id long, embedding array<double>, name string, version int")
    index.upsert(rows)
    index.upsert(spark.createDataFrame([(2, [0.6, 0.8], "old", 2), (2, [0.8, 0.6], "new", 3), (3, [0.0, 1.0], "c", 1)], rows.schema), "version")
    assert index.vector(2) == [0.8, 0.6] and index.metadata(2) == {"name": "new", "version": 3} and index.metadata(9) is None
    assert [r.vec_id for r in index.search([1.0, 0.0], 2).collect()] == [1, 2]
    index.remove(spark.createDataFrame([(1,)], "vec_id long"))
    assert {r.vec_id for r in index.load().collect()} == {2, 3} and len(index._versions()) == 1
    index.clear()
    with pytest.raises(LookupError):
        index.vector(1)


def test_newest_rows_win_whatever_the_order(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "z", None), ("b", "q", None), (None, "n", 1)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "k string, v string, t int")
        assert {(r.k, r.v) for r in hybrid.newest(df, ["k"], "t").collect()} == {("a", "y"), ("b", "q"), (None, "n")}


def test_similar_and_hashed_search(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.9, 0.1], "a"), (2, [0.8, 0.2], "b"), (3, [0.0, 1.0], "c")], "vec_id long, embedding array<double>, name string")
    assert [r.vec_id for r in vectors.similar_to(df, 0, 5, 0.3).collect()] == [2]
    assert vectors.similar_to(df, 99, 5).count() == 0
    assert [r.vec_id for r in vectors.hashed_search(df, [1.0, 0.0], 2).collect()] == [0, 1]
    assert vectors.hashed_search(df.limit(0), [1.0, 0.0], 2).count() == 0


def test_profiles(spark):
    f = spark.createDataFrame([(1, "a", "x", 1.0), (2, "b", "x", 2.0), (3, "c", "y", 9.0), (4, "a", "y", 0.0)], "id long, name string, file_path string, complexity_score double").withColumn("parent_class", F.lit(None).cast("string"))
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    row = profile.importance_profile(f, e, "a").first()
    assert (row.id, row.n_functions, row.n_dependencies, row.n_direct) == (1, 4, 2, 1) and row["rank"] == 3
    assert profile.importance_profile(f, e, "zz").count() == 0
    eco = {r.id: r for r in profile.ecosystem(f, e, "b", f.limit(2)).collect()}
    assert (eco[2].callees, eco[2].callers, eco[2].n_similar) == (["c"], ["a"], 2)


def test_search_by_signature_and_rerank(spark):
    from graphloom.plans.search import Searcher, SearchRequest, inferred_filters

    rows = [(1, "one", "a.py", "python", [1.0, 0.0]), (2, "two", "b.py", "python", [0.8, 0.6])]
    asked = []
    s = Searcher(spark.createDataFrame(rows, "id long, content string, filepath string, language string, embedding array<double>"), lambda q: asked.append(q) or [1.0, 0.0], rerank=lambda q, found: found.withColumn("score", -F.col("score")))
    assert [r.id for r in s.by_example("x").orderBy("rnk").collect()] == [1, 2]
    assert [r.id for r in s.by_signature("f", ["a", "b"], "int").orderBy("rnk").collect()] == [1, 2] and asked[-1] == "function f parameters: a, b returns: int"
    assert [r.id for r in s.search(SearchRequest("q", "ai")).orderBy("rnk").collect()] == [2, 1]
    hits = spark.createDataFrame([(1, "a.py"), (9, "z.py")], "id long, filepath string")
    assert {(r.id, r.score > 0) for r in s.with_graph_hits(s.by_example("x"), hits).collect()} == {(1, True), (2, True), (9, False)}
    assert inferred_filters("find hard test in class Foo of path a/b") == {"file_path": "a/b", "parent_class": "Foo", "min_complexity": 5.0, "function_type": "test"}
    assert inferred_filters("easy things") == {"max_complexity": 3.0} and inferred_filters("the function load") == {"name": "the"}


def test_sources(spark, tmp_path):
    (tmp_path / "shop_complete_v1.json").write_text('{"functions": [{"name": "f", "n": 1}, {"name": "g", "n": 2}], "total": 2}')
    assert {(r.repository, r.name) for r in files.complete_functions(spark, str(tmp_path)).collect()} == {("shop", "f"), ("shop", "g")}
    old = spark.createDataFrame([("a", "File", "x", None), ("b", "File", "y", 1)], "id string, label string, name string, n int")
    new = spark.createDataFrame([("a", "File", None, 5), ("c", "File", "z", 2)], "id string, label string, name string, n int")
    assert {tuple(r) for r in graph.merged(old, new, ["id", "label"]).collect()} == {("a", "File", "x", 5), ("b", "File", "y", 1), ("c", "File", "z", 2)}
    rows = spark.createDataFrame([(1, "f", "a.py", "K"), (2, "g", None, None)], "vec_id long, name string, file_path string, parent_class string")
    nodes, edges = graph.graph_of_index(rows, spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert nodes.count() == 4 and {r.type for r in edges.collect()} == {"CONTAINS", "HAS_METHOD", "CALLS"}
    entries = files.index_entries(spark.createDataFrame([("b.py", "x"), ("a.py", "y")], "path string, content string"), F.lit("2024-01-01"))
    assert [r.path for r in files.indexed_files(entries, 1).collect()] == ["a.py"]
    files.save(entries, str(tmp_path / "t"))
    files.clear(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_fetching_tries_again(tmp_path):
    seen, waits = [], []

    def run(command, folder, timeout):
        seen.append(command)
        if len(seen) < 5:
            raise subprocess.CalledProcessError(1, command)

    assert repositories.fetch("https://host.example/a/one.git", str(tmp_path), ["src"], run=run, wait=waits.append) == tmp_path / "one"
    assert waits == [1, 1, 1, 2] and seen[-1] == ["checkout"]
    with pytest.raises(RuntimeError):
        repositories.fetch("https://host.example/a/two.git", str(tmp_path), rounds=1, run=lambda *a: (_ for _ in ()).throw(OSError()), wait=waits.append)


def test_remaining_lists(spark):
    from graphloom.functions.describe import describe
    from graphloom.functions.embed import embed, embedder
    from graphloom.operators import callgraph, centrality, metrics, ranking
    from graphloom.plans.search import Searcher

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 1)], "src long, dst long")
    chains = {(r.src, r.dst): r.nodes for r in callgraph.shortest_chains(edges, 3).collect()}
    assert chains[1, 3] == [1, 2, 3] and chains[2, 4] == [2, 3, 1, 4] and (1, 1) not in chains
    one = spark.createDataFrame([(4,)], "id long")
    around = {way: {(r.src, r.dst) for r in callgraph.graph_around(edges, one, 1, way).collect()} for way in ("out", "in", "both")}
    assert around == {"out": {(4, 3)}, "in": {(1, 4)}, "both": {(4, 3), (1, 4)}}
    f = spark.createDataFrame([(1, "f", "a"), (2, "g", "a")], "id long, name string, file_path string")
    calls = spark.createDataFrame([(1, "print"), (2, "print"), (1, "g"), (2, "open")], "id long, callee string")
    assert [(r.group, r.names, r.n) for r in callgraph.external_calls(f, calls).collect()] == [("a", ["open", "print"], 2)]
    typed = edges.withColumn("type", F.when(F.col("src") == 1, "CALLS").otherwise("USES"))
    assert callgraph.neighbours(typed, spark.createDataFrame([(1,)], "id long"), ["USES"]).count() == 1
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4)], "id long, community long")
    assert [(r.community, r.n) for r in centrality.communities(labels).orderBy("rnk").collect()] == [(4, 3), (1, 2)]
    stats = metrics.class_stats(spark.createDataFrame([("K", "f", "abstract x"), ("K", "__g", None), ("L", "_h", None)], "parent_class string, name string, code string"), "code")
    assert {(r.parent_class, r.n_private, r.n_magic, r.is_abstract) for r in stats.collect()} == {("K", 1, 1, True), ("L", 1, 0, False)}
    heavy = edges.withColumn("w", F.when(F.col("dst") == 2, 3.0).otherwise(1.0))
    ranks = {r.id: r["rank"] for r in ranking.pagerank(spark.range(1, 5), heavy, weight="w").collect()}
    assert ranks[2] > 2 * ranks[4] and sum(ranks.values()) == pytest.approx(1)
    texts = spark.createDataFrame([(1, "read file read"), (2, "write file")], "id long, content string")
    model = embedder(50, vocabulary=True).fit(texts)
    assert all(sum(x * x for x in r.embedding) in (0.0, pytest.approx(1)) for r in embed(model, texts).collect())
    tries = spark.createDataFrame([("s1", "code"), ("s2", "code")], "seq string, code string").coalesce(1)
    seen = []

    def client(codes):
        seen.append(len(codes))
        if len(seen) < 3:
            raise OSError
        return "One.---Two."

    told = describe(tries, client, attempts=4, wait=0.0).collect()
    assert [r.docstring.description for r in told] == ["One.", "Two."] and not any(r.has_error for r in told)
    assert all(r.has_error for r in describe(tries, lambda codes: ["one"], attempts=2, wait=0.0).collect())
    found = Searcher.suggest("re", spark.createDataFrame([("read",)], "name string"), spark.createDataFrame([("More. re, (reader)!",)], "docstring string"), spark.createDataFrame([("where",)], "query string"))
    assert [r.text for r in found.collect()] == ["More", "read", "where", "(reader)"]
