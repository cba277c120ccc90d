"""Command line: extract source trees into tables, describe and index their functions, and ask them."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import context, parse
from graphloom.functions import text as T
from graphloom.functions.braces import BRACED
from graphloom.functions.describe import split_docstring
from graphloom.functions.embed import embed, embedder
from graphloom.operators import callgraph, centrality, complexity, filters, metrics, ranking
from graphloom.operators.components import connected_components
from graphloom.operators.index import VectorIndex
from graphloom.plans import profile
from graphloom.session import get_session, materialize, shared_path
from graphloom.sources import files, graph
from graphloom.sources.repositories import fetch

TABLES = ("functions", "classes", "calls", "edges", "nodes")


def extract(spark: SparkSession, root: str, out: str, repository: str, large: int = 0) -> dict[str, DataFrame]:
    """Parse the sources under a folder and store functions, classes, calls, nodes and edges; returns the tables."""
    found = files.source_files(spark, root).select("path", "content").filter(T.language(F.col("path")).isin("python", *BRACED))
    found = files.decoded(found)
    functions = parse.functions_of(found).withColumn("repository", F.lit(repository))
    if large:
        functions = parse.large_functions(functions, large)
    files.save(functions, f"{out}/functions")
    functions = files.load(spark, f"{out}/functions")
    calls = parse.calls_of(functions)
    for name, table in (("classes", parse.classes_of(found)), ("calls", calls), ("nodes", graph.nodes(functions)), ("edges", graph.edges(functions, calls))):
        files.save(table, f"{out}/{name}")
    return {name: files.load(spark, f"{out}/{name}") for name in TABLES}


def canonical(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """functions with id and complexity_score, and distinct call edges between those ids."""
    f = tables["functions"]
    fid = graph.function_id(F.col("repository"), F.col("file_path"), F.col("name"), F.col("start_line"), F.col("end_line"))
    score = F.col("cyclomatic_complexity") * F.col("lines_of_code") / F.lit(10.0)
    return f.withColumns({"id": fid, "complexity_score": score.cast("double")}), callgraph.distinct_edges(tables["edges"].filter("type = 'CALLS'").select("src", "dst"))


def ask(tables: dict[str, DataFrame], command: str, name: str = "", depth: int = 3, limit: int = 20, algorithm: str = "pagerank") -> DataFrame:
    """The answer to one command of the command line."""
    functions, edges = canonical(tables)
    named = functions.filter(F.col("name") == name).select("id")
    if command == "search":
        return filters.by_name(functions, name, exact=False).select("id", "name", "file_path", "complexity_score").limit(limit)
    if command == "callees":
        return callgraph.closure(edges, depth, named).select("dst", "depth").orderBy("depth", "dst").limit(limit)
    if command == "callers":
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return callgraph.closure(back, depth, named).select(F.col("dst").alias("src"), "depth").orderBy("depth", "src").limit(limit)
    if command == "dependencies":
        return callgraph.grouped_dependencies(functions, edges, "file_path").orderBy(F.desc("n_calls"), "from_group", "to_group").limit(limit)
    if command == "centrality":
        nodes = functions.select("id")
        scores = {
            "pagerank": lambda: ranking.pagerank(nodes, edges).select("id", F.col("rank").alias("score")),
            "closeness": lambda: centrality.closeness(nodes, edges).select("id", F.col("closeness").alias("score")),
            "betweenness": lambda: centrality.betweenness(nodes, edges).select("id", F.col("betweenness").alias("score")),
            "eigenvector": lambda: centrality.eigenvector(nodes, edges).select("id", F.col("centrality").alias("score")),
            "importance": lambda: ranking.hybrid(functions, edges).select("id", "score"),
        }[algorithm]()
        return callgraph.top(scores, limit, F.desc("score"), "id")
    if command == "communities":
        found = {"components": lambda: connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("community")), "louvain": lambda: centrality.louvain_level(functions.select("id"), edges)}
        groups = found.get(algorithm, lambda: centrality.label_propagation(functions.select("id"), edges))()
        return groups.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(limit)
    if command == "analyze":
        return callgraph.function_context(functions, edges).join(callgraph.degrees(functions, edges), "id").filter(F.col("name") == name).limit(limit)
    return metrics.graph_statistics(functions, edges)


def batch(spark: SparkSession, listing: str, out: str, folder: str, large: int = 0, **fetching) -> DataFrame:
    """Fetch and extract each repository of a list; returns stage, ok, seconds, repository, error of each run.

    A repository that cannot be fetched or read is a failed run, and the others go on.
    """
    runs = []
    for row in files.repository_urls(spark, listing).collect():  # a list of names that a person wrote
        for stage, work in (("fetch", lambda r=row: fetch(r.url, folder, **fetching)), ("extract", lambda r=row: extract(spark, f"{folder}/{r.name}", f"{out}/{r.name}", r.name, large))):
            begun, error = time.perf_counter(), None
            try:
                work()
            except Exception as e:  # noqa: BLE001 - whatever fails, the table of runs says so
                error = f"{type(e).__name__}: {e}"[:500]
            runs.append((stage, error is None, time.perf_counter() - begun, row.name, error))
            if error:
                break
    return spark.createDataFrame(runs, "stage string, ok boolean, seconds double, repository string, error string")


def described(tables: dict[str, DataFrame]) -> DataFrame:
    """The functions with their docstrings in parts, complexity level and context summary."""
    functions, _ = canonical(tables)
    level = complexity.level(F.col("complexity_score"))
    names = F.transform("calls", lambda c: c["name"])
    summary = context.fallback_summary(F.col("file_path"), F.col("parent_class"), F.col("imports"), F.size(names))
    return functions.select("id", "name", "file_path", "parent_class", split_docstring(F.col("docstring")).alias("docstring"), level.alias("level"), summary.alias("summary"))


def ingest(spark: SparkSession, path: str, out: str, clean: bool = False) -> DataFrame:
    """Merge the functions of complete JSON files into the stored nodes of a graph; returns the nodes."""
    if clean:
        files.clear(spark, f"{out}/nodes")
    rows = files.complete_functions(spark, path)
    new = rows.select(F.concat_ws(":", "repository", "name").alias("id"), F.lit("Function").alias("label"), "name", "repository")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/nodes")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        new = graph.merged(files.load(spark, f"{out}/nodes"), new, ["id", "label"])
    files.save(materialize(new, "nodes"), f"{out}/nodes")
    return files.load(spark, f"{out}/nodes")


def build_index(tables: dict[str, DataFrame], folder: str, size: int = 1024) -> tuple[VectorIndex, PipelineModel]:
    """Embed the functions' descriptions into a vector index; returns it and the embedding."""
    functions, _ = canonical(tables)
    row = {"name": F.col("name"), "description": F.col("docstring"), "code": F.col("code")}
    rows = materialize(functions.select(F.xxhash64("id").alias("vec_id"), F.col("id").alias("function"), "file_path", context.search_description(row).alias("content")), "descriptions")
    model = embedder(size).fit(rows)
    index = VectorIndex(functions.sparkSession, folder)
    index.save(embed(model, rows))
    return index, model


def shell(answer: Callable[[str, str], DataFrame], read: Callable[[], str] = input, write: Callable[[str], None] = print) -> None:
    """Answer lines of a command and its text until `quit` or the end of input."""
    while True:
        try:
            command, _, rest = read().strip().partition(" ")
        except EOFError:
            return
        if command in ("quit", "exit"):
            return
        if command:
            try:
                write(files.markdown(answer(command, rest), command))
            except Exception as e:  # noqa: BLE001 - a bad line does not end the session
                write(f"{type(e).__name__}: {e}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    e = commands.add_parser("extract", help="parse a source tree into tables")
    e.add_argument("root")
    e.add_argument("out")
    e.add_argument("--repository", default="local")
    e.add_argument("--large", type=int, default=0, help="keep only functions of more lines")
    b = commands.add_parser("batch", help="fetch and extract the repositories of a list")
    b.add_argument("listing")
    b.add_argument("out")
    b.add_argument("folder", help="where clones go")
    b.add_argument("--large", type=int, default=0)
    i = commands.add_parser("ingest", help="merge complete JSON files into a graph")
    i.add_argument("path")
    i.add_argument("out")
    i.add_argument("--clean", action="store_true")
    for command, text in (("describe", "write descriptions"), ("index", "write a vector index"), ("shell", "answer commands from the keyboard")):
        p = commands.add_parser(command, help=text)
        p.add_argument("tables", help="folder that extract wrote")
        if command != "shell":
            p.add_argument("out")
    v = commands.add_parser("similar", help="functions whose descriptions are like a text")
    v.add_argument("tables")
    v.add_argument("name")
    v.add_argument("--limit", type=int, default=10)
    for command in ("search", "callers", "callees", "dependencies", "centrality", "communities", "analyze", "info"):
        p = commands.add_parser(command)
        p.add_argument("tables", help="folder that extract wrote")
        if command in ("search", "callers", "callees", "analyze"):
            p.add_argument("name")
        p.add_argument("--depth", type=int, default=3)
        p.add_argument("--limit", type=int, default=20)
        p.add_argument("--algorithm", default="pagerank")
    args = parser.parse_args(argv)
    spark = get_session("graphloom-cli")
    if args.command == "extract":
        made = extract(spark, args.root, args.out, args.repository, args.large)
        print("\n".join(f"{name}: {table.count()}" for name, table in made.items()))
        return 0
    if args.command == "batch":
        print(files.markdown(profile.run_summary(batch(spark, args.listing, args.out, args.folder, args.large)), "runs"))
        return 0
    if args.command == "ingest":
        print(f"nodes: {ingest(spark, args.path, args.out, args.clean).count()}")
        return 0
    tables = {name: files.load(spark, f"{args.tables}/{name}") for name in TABLES}
    if args.command == "describe":
        files.save(described(tables), args.out)
        return 0
    if args.command == "index":
        build_index(tables, args.out)
        return 0
    if args.command == "similar":
        index, model = build_index(tables, shared_path(spark, "index"))
        text = spark.createDataFrame([(args.name,)], "content string")
        found = index.search(list(embed(model, text).first()["embedding"]), args.limit, metric="ip")
        print(files.markdown(found.join(index.load().select("vec_id", "function"), "vec_id").orderBy("rnk").select("function", "score"), "similar", args.limit))
        return 0
    if args.command == "shell":
        shell(lambda command, rest: ask(tables, command, rest))
        return 0
    print(files.markdown(ask(tables, args.command, getattr(args, "name", ""), args.depth, args.limit, args.algorithm), args.command, args.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
