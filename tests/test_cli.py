from graphloom import cli
from graphloom.functions.embed import embed

CODE = """def a():
    return b() + c()

def b():
    return c()

def c():
    return 1

class K:
    def d(self):
        return a()
"""


def test_extract_and_ask(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text(CODE)
    tables = cli.extract(spark, str(tmp_path / "src"), str(tmp_path / "out"), "r")
    assert {n: t.count() for n, t in tables.items()}["functions"] == 4
    short = lambda i: i.rsplit(":", 2)[-2]
    assert [(short(r.dst), r.depth) for r in cli.ask(tables, "callees", "d").collect()] == [("a", 1), ("b", 2), ("c", 2)]
    assert {short(r.src) for r in cli.ask(tables, "callers", "c").collect()} == {"a", "b", "d"}
    assert short(cli.ask(tables, "centrality", limit=1).first().id) == "c"
    assert cli.ask(tables, "communities", algorithm="components").first().n == 4
    assert cli.ask(tables, "info").first().n_edges == 4
    assert cli.ask(tables, "analyze", "a").first().callees == ["b", "c"]
    assert cli.ask(tables, "search", "a").count() == 1


def test_describe_index_ingest_and_batch(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text('import os\ndef load_file(path):\n    """Read a file."""\n    return open(path)\n\ndef add(a, b):\n    """Sum of numbers."""\n    return a + b\n')
    (tmp_path / "src" / "n.go").write_text("package n\nfunc Run(x int) int {\n\treturn x\n}\n")
    tables = cli.extract(spark, str(tmp_path / "src"), str(tmp_path / "out"), "r")
    told = {r.name: r for r in cli.described(tables).collect()}
    assert told["load_file"].docstring.description == "Read a file." and told["load_file"].summary.startswith("文件: m.py") and "Run" in told
    index, model = cli.build_index(tables, str(tmp_path / "index"), 256)
    query = list(embed(model, spark.createDataFrame([("read a file",)], "content string")).first()["embedding"])
    best = index.search(query, 1, metric="ip").first()
    assert ":load_file:" in index.metadata(best.vec_id)["function"]
    (tmp_path / "a_complete.json").write_text('{"functions": [{"name": "f"}]}')
    assert cli.ingest(spark, str(tmp_path / "a_complete.json"), str(tmp_path / "g")).count() == 1
    (tmp_path / "a_complete.json").write_text('{"functions": [{"name": "f"}, {"name": "g"}]}')
    assert cli.ingest(spark, str(tmp_path / "a_complete.json"), str(tmp_path / "g")).count() == 2
    (tmp_path / "list.txt").write_text("https://host.example/a/src\nhttps://host.example/a/none\n")

    def run(command, folder, timeout):
        raise OSError("no network")

    runs = cli.batch(spark, str(tmp_path / "list.txt"), str(tmp_path / "all"), str(tmp_path), rounds=1, run=run, wait=lambda s: None)
    assert sorted((r.repository, r.stage, r.ok) for r in runs.collect()) == [("none", "fetch", False), ("src", "extract", True), ("src", "fetch", True)]
    said, lines = [], iter(["info", "nonsense!", "callees load_file", "quit"])
    cli.shell(lambda command, rest: cli.ask(tables, command, rest), lambda: next(lines), said.append)
    assert len(said) == 3 and "n_nodes" in said[0]
