import pytest
from pyspark.sql import functions as F

from graphloom.functions import parse as P
from graphloom.functions import text as T
from graphloom.functions.describe import describe
from graphloom.operators import complexity, filters, hybrid, metrics, vectors
from graphloom.sources import files as S
from graphloom.sources import graph as GS

CODE = '''import os
from math import floor as f, sqrt

class Base:
    pass

class Search(Base):
    """Searches."""

    def __init__(self, items: list, k=3):
        self.items = items

    async def find(self, x) -> int:
        """Find x.

        Args:
            x: what to find
        Returns:
            its place
        """
        if x in self.items and x > 0:
            return self.items.index(x)
        return helper(x)

def helper(x):
    for i in range(3):
        x += sqrt(i)
    return x
'''


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "pkg").mkdir()
    (root / "pkg" / "search.py").write_text(CODE)
    (root / "pkg" / "broken.py").write_text("def broken(:\n  pass\n")
    (root / "README.md").write_text("# read")
    (root / "repos.txt").write_text("https://host.example/a/one\n\n# no\nhttps://host.example/b/two.git\n")
    return root


def test_scan_and_parse(spark, tree):
    scanned = S.source_files(spark, str(tree)).filter(S.indexable(F.col("path"), F.col("length"), [".py"], ["venv", "*/nope/*"]))
    files = S.decoded(scanned.select("path", "content"))
    assert {r.path.rsplit("/", 1)[1]: r.language for r in S.file_records(files).collect()} == {"search.py": "python", "broken.py": "python"}
    functions = P.functions_of(files).cache()
    rows = {r.name: r for r in functions.collect()}
    assert rows.keys() == {"__init__", "find", "helper"}
    assert rows["find"].is_async and rows["find"].parent_class == "Search" and rows["find"].return_type == "int"
    assert [p.name for p in rows["__init__"].parameters] == ["self", "items", "k"] and rows["__init__"].parameters[2].default == "3"
    assert rows["find"].cyclomatic_complexity == 3 and rows["helper"].branch_count == 1
    assert rows["helper"].imports == ["os", "math.floor", "math.sqrt"]
    calls = {(r.callee, r.internal) for r in P.calls_of(functions).collect()}
    assert calls == {("index", False), ("helper", True), ("range", False), ("sqrt", False)}
    assert [(r.class_name, r.bases, r.methods) for r in P.classes_of(files).collect()] == [("Base", [], []), ("Search", ["Base"], ["__init__", "find"])]
    bodies = {r.name: r.body for r in P.bodies_by_indent(files).collect()}
    assert bodies["helper"].endswith("return x") and bodies["broken"] == "def broken(:\n  pass"
    described = {r.seq: r.docstring for r in describe(functions).collect()}
    doc = described[rows["find"].seq]
    assert (doc.description, doc.args, doc.returns) == ("Find x.", "x: what to find", "its place")
    failed = describe(functions, lambda codes: 1 / 0).collect()
    assert all(r.has_error for r in failed) and len(failed) == 3
    f = functions.withColumns({"repository": F.lit("r")})
    edges = {(r.type, r.dst.rsplit(":", 2)[-2] if r.type == "CALLS" else r.dst) for r in GS.edges(f, P.calls_of(functions)).collect()}
    assert ("CALLS", "helper") in edges and ("EXTERNAL_CALL", "sqrt") in edges
    assert S.repeated_keys(GS.nodes(f), ["id"]).isEmpty()


def test_repository_list_and_export(spark, tree, tmp_path):
    assert [(r.url, r.name) for r in S.repository_urls(spark, str(tree / "repos.txt")).collect()] == [("https://host.example/a/one.git", "one"), ("https://host.example/b/two.git", "two")]
    df = spark.createDataFrame([(1, "a|b", ["x"])], "id int, t string, l array<string>")
    assert "a\\|b" in S.markdown(df, "T") and S.markdown(df, "T").startswith("# T")
    S.save(df, str(tmp_path / "t"))
    assert S.load(spark, str(tmp_path / "t"), [F.desc("id")]).count() == 1
    assert dict(S.flattened(df.withColumn("s", F.struct("id"))).dtypes)["s"] == "string"


def test_classifiers(spark):
    df = spark.createDataFrame([("test_x", "def test_x(a, b) -> int: pass"), ("__init__", ""), ("_p", ""), ("go", "async def go(): pass"), ("gen", "yield 1"), ("dec", "@x\ndef dec(): pass"), ("plain", "x")], "name string, code string")
    got = {r.name: (r.t, r.n, r.ret) for r in df.select("name", T.function_type(F.col("name"), F.col("code")).alias("t"), T.parameter_count(F.col("code")).alias("n"), T.return_type(F.col("code")).alias("ret")).collect()}
    assert [got[n][0] for n in ("test_x", "__init__", "_p", "go", "gen", "dec", "plain")] == ["test", "magic_method", "private", "async", "generator", "decorated", "regular"]
    assert got["test_x"][1:] == (2, "int")
    two = spark.createDataFrame([("def test_function(x):\n    return x + 1",)], "c string").select(T.heuristic_complexity(F.col("c")).alias("x"), T.heuristic_importance(F.lit("test_function"), F.col("c")).alias("y")).first()
    assert (two.x, two.y) == (1.2, 1.0)


def test_statistics_of_small_populations(spark):
    one = metrics.population_statistics(spark.createDataFrame([(5.0,), (-1.0,), (None,)], "v double"), "v").first()
    assert (one["n"], one["std"], one["median"], one["q25"]) == (1, 0.0, 5.0, 5.0)
    two = metrics.population_statistics(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v").first()
    assert (two["median"], two["q25"], two["q75"]) == (3.0, 1.0, 3.0)
    assert metrics.population_statistics(spark.createDataFrame([], "v double"), "v").first()["n"] == 0
    buckets = {r.bucket for r in metrics.complexity_buckets(spark.createDataFrame([(None,), (7.0,)], "complexity_score double")).collect()}
    assert buckets == {"low", "high"}


def test_vectors_and_groups(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.9, 0.4]), (4, [0.0, 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.a, r.b) for r in vectors.similar_pairs(df, 0.95, cells=3).orderBy("a", "b").collect()] == [(1, 2), (2, 3)]
    pairs = vectors.similar_pairs(df, 0.95, cells=2)
    assert {r.vec_id: r.group for r in vectors.duplicate_groups(pairs).collect()} == {1: 1, 2: 1, 3: 1}
    assert {(r.leader, r.member) for r in vectors.leader_groups(pairs).collect()} == {(1, 2)}
    assert [r.vec_id for r in vectors.top_k(df, [1.0, 0.0], 2, "l2", threshold=0.2).collect()] == [1, 2]


def test_merges_changes_and_filters(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "id string, score double")
    b = spark.createDataFrame([("y", 1.0), ("z", 1.0)], "id string, score double")
    assert [(r.id, r.combined_score) for r in hybrid.merge(a, b, ["id"]).orderBy("rnk").collect()] == [("x", 0.7), ("y", 0.65), ("z", 0.3)]
    old, new = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string"), spark.createDataFrame([("b", "2"), ("c", "1")], "path string, hash string")
    assert {(r.path, r.change) for r in hybrid.changes(old, new).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "added")}
    assert {(r.path, r.hash) for r in hybrid.upsert(old, new, ["path"]).collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    hits = filters.any_keyword(spark.createDataFrame([("50% 'off'",), (None,), ("x",)], "t string"), ["% 'o"], ["t"]).collect()
    assert len(hits) == 1
    assert complexity.adaptive(spark.createDataFrame([], "id long, cyclomatic_complexity int, lines_of_code int, branch_count int, parameters int")).count() == 0


def test_search_facade(spark):
    from graphloom.plans.search import Searcher, SearchRequest, inferred_filters

    rows = [(1, "binary search\nfind element", "a.py", "python", [1.0, 0.0]), (2, "sort things", "search.py", "python", [0.0, 1.0]), (3, "other", "b.js", "js", [0.7, 0.7])]
    s = Searcher(spark.createDataFrame(rows, "id long, content string, filepath string, language string, embedding array<double>"), lambda q: [1.0, 0.0])
    assert [r.id for r in s.search(SearchRequest("search", "keyword")).orderBy("rnk").collect()] == [2, 1]
    assert [r.id for r in s.search(SearchRequest("search")).orderBy("rnk").collect()] == [1, 3, 2]
    assert [r.id for r in s.search(SearchRequest("search", "semantic", filters={"language": "js"})).collect()] == [3]
    assert inferred_filters("async function named load in file io/x.py") == {"name": "async", "file_path": "io/x.py", "function_type": "async"}
