"""Call graphs: degrees, dependencies, paths, reachability, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

from . import reach

#: Calls up to which pairs from all nodes are found by joins.
NEAR = 4


def distinct_edges(calls: DataFrame) -> DataFrame:
    """src, dst of each different call that is no self loop."""
    return calls.filter("src != dst").distinct()


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in an order that ends in a unique key, with their rank from 1."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rnk", F.row_number().over(Window.orderBy(*order)).cast("int"))


def most_called(functions: DataFrame, calls: DataFrame, k: int = 10) -> DataFrame:
    """id, name, call_count, rnk of the k functions that most call records have as their target."""
    counts = calls.groupBy("dst").agg(F.count("*").alias("call_count"))
    known = counts.join(functions.select("id", "name"), F.col("dst") == F.col("id"))
    return top(known.select("id", "name", "call_count"), k, F.desc("call_count"), "id")


def graph_counts(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges (call records), n_isolated (functions that nothing calls)."""
    called = calls.select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(1))
    nodes = functions.select("id").join(called, "id", "left").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("hit").isNull()).alias("n_isolated"))
    return nodes.crossJoin(calls.agg(F.count("*").alias("n_edges"))).select("n_nodes", "n_edges", "n_isolated")


def resolve_names(functions: DataFrame) -> DataFrame:
    """name, id: of functions that share a name the last one, at the place of the first (first_seq)."""
    return functions.groupBy("name").agg(F.max_by("id", "seq").alias("id"), F.min("seq").alias("first_seq"))


def named_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst with each call resolved by the name of its target."""
    names = functions.select(F.col("id").alias("dst"), "name")
    return calls.join(names, "dst").join(resolve_names(functions).withColumnRenamed("id", "target"), "name").select("src", F.col("target").alias("dst"))


def grouped_dependencies(functions: DataFrame, calls: DataFrame, by: str) -> DataFrame:
    """from_group, to_group of calls between different files, classes or whatever `by` names; null groups are left out."""
    f = functions.filter(F.col(by).isNotNull())
    a, b = f.select(F.col("id").alias("src"), F.col(by).alias("from_group")), f.select(F.col("id").alias("dst"), F.col(by).alias("to_group"))
    pairs = calls.join(a, "src").join(b, "dst").filter("from_group != to_group")
    return pairs.groupBy("from_group", "to_group").agg(F.count("*").alias("n_calls"))


def degrees(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree over distinct edges, zero where there is none."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    joined = functions.select("id").join(out, "id", "left").join(into, "id", "left")
    return joined.select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def impact(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degrees and role: hub calls and is called, leaf is only called, root only calls, isolated neither."""
    d = degrees(functions, edges)
    role = F.when((F.col("out_degree") > 0) & (F.col("in_degree") > 0), "hub").when(F.col("in_degree") > 0, "leaf").when(F.col("out_degree") > 0, "root").otherwise("isolated")
    return d.withColumn("role", role)


def closure(edges: DataFrame, max_depth: int = 20, sources: DataFrame | None = None) -> DataFrame:
    """src, dst, depth: every pair within max_depth calls, with the length of the shortest path; src = dst on cycles.

    From some sources, or not far: a breadth-first frontier of pairs; each round joins the frontier with the edges and
    drops the pairs that are known. Far from all nodes, where pairs are most of all pairs: `reach`.
    """
    if sources is None and max_depth > NEAR:
        return reach.pairs(edges, max_depth)
    edges = edges.select("src", "dst").distinct()
    start = edges if sources is None else edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    known = frontier = materialize(start.withColumn("depth", F.lit(1)), "reach")
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for depth in range(2, max_depth + 1):
        fresh = frontier.join(step, "dst").select("src", F.col("next").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti")
        frontier = materialize(fresh.withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def paths(edges: DataFrame, max_depth: int, sources: DataFrame | None = None, loops: bool = True) -> DataFrame:
    """src, dst, depth, nodes: every trail of 1 to max_depth edges; no edge twice, nodes may repeat (if loops).

    Each further edge is one join on the end of the trails so far.
    """
    e = edges.select("src", "dst").distinct()
    start = e if sources is None else e.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    trails = start.select("src", "dst", F.lit(1).alias("depth"), F.array("src", "dst").alias("nodes"))
    found = trails
    step = e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    for depth in range(2, max_depth + 1):
        longer = trails.join(step, F.col("dst") == F.col("at"))
        used = F.exists(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: (F.get("nodes", i) == F.col("at")) & (F.get("nodes", i + 1) == F.col("next")))
        longer = longer.filter(~used if loops else ~F.array_contains("nodes", F.col("next")))
        trails = longer.select("src", F.col("next").alias("dst"), F.lit(depth).alias("depth"), F.concat("nodes", F.array("next")).alias("nodes"))
        found = found.unionByName(trails)
    return found


def simple_cycles(edges: DataFrame, max_length: int = 3) -> DataFrame:
    """cycle (nodes from the smallest, the first not repeated), length: every simple cycle of 2 to max_length nodes."""
    e = edges.filter("src != dst").select("src", "dst").distinct()
    walk = e.filter("src < dst").select(F.array("src", "dst").alias("nodes"), F.col("src").alias("first"), F.col("dst").alias("last"))
    back = e.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    closed = walk.join(back, ["last", "first"]).select("nodes")
    for _ in range(3, max_length + 1):
        walk = walk.join(step, "last").filter((F.col("next") > F.col("first")) & ~F.array_contains("nodes", F.col("next")))
        walk = walk.select(F.concat("nodes", F.array("next")).alias("nodes"), "first", F.col("next").alias("last"))
        closed = closed.unionByName(walk.join(back, ["last", "first"]).select("nodes"))
    return closed.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("cycle"), F.size("nodes").alias("length"))


def shortest_chains(edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """src, dst, depth, nodes: for each pair within max_depth calls one shortest path, the first in the order of its nodes.

    Each level keeps one path of a pair before the next, so rows are pairs, not paths.
    """
    e = edges.filter("src != dst").select("src", "dst").distinct()
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    level = known = materialize(e.select("src", "dst", F.lit(1).alias("depth"), F.array("src", "dst").alias("nodes")), "chains")
    for depth in range(2, max_depth + 1):
        longer = level.join(step, "dst").filter("src != next").select("src", F.col("next").alias("dst"), F.concat("nodes", F.array("next")).alias("nodes"))
        best = longer.groupBy("src", "dst").agg(F.min("nodes").alias("nodes")).join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        level = materialize(best.select("src", "dst", F.lit(depth).alias("depth"), "nodes"), "chains")
        known = known.unionByName(level)
    return known


def graph_around(edges: DataFrame, sources: DataFrame, max_depth: int = 3, direction: str = "out", distinct_edges: bool = True) -> DataFrame:
    """src, dst of the edges on trails of up to max_depth edges that leave the sources (out), reach them (in), or both."""
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("src"), F.get("nodes", i + 1).alias("dst"))))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = None
    for way, rows in (("out", edges), ("in", turned)):
        if direction in (way, "both"):
            part = paths(rows, max_depth, sources).select(steps.alias("e")).select("e.*")
            part = part if way == "out" else part.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            found = part if found is None else found.unionByName(part)
    return found.distinct() if distinct_edges else found


def external_calls(functions: DataFrame, calls: DataFrame, by: str = "file_path") -> DataFrame:
    """group, names, n: the names that a group's functions call and no function has. calls: id, callee (a name)."""
    known = functions.select(F.col("name").alias("callee")).distinct()
    outside = calls.join(known, "callee", "left_anti").join(functions.select("id", F.col(by).alias("group")), "id")
    return outside.select("group", "callee").distinct().groupBy("group").agg(F.array_sort(F.collect_list("callee")).alias("names"), F.count("*").alias("n"))


def neighbours(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None) -> DataFrame:
    """id, neighbour: nodes joined to a seed by an edge of either direction; types: of edges that have a column `type`."""
    edges = edges.filter(F.col("type").isin(types)) if types else edges
    s = seeds.select("id")
    out = edges.join(s, F.col("src") == F.col("id")).select("id", F.col("dst").alias("neighbour"))
    into = edges.join(s, F.col("dst") == F.col("id")).select("id", F.col("src").alias("neighbour"))
    return out.unionByName(into).distinct()


def function_context(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, file_path, parent_class, callees, callers: names in order, sets made before the joins so nothing fans out."""
    names = functions.select("id", "name")
    callees = edges.join(names.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("callees"))
    callers = edges.join(names.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("callers"))
    joined = functions.select("id", "name", "file_path", "parent_class").join(callees, "id", "left").join(callers, "id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("callees", "callers")})
