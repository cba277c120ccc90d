"""The property graph as tables: nodes and edges of each label, with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.callgraph import resolve_names


def file_id(repository: Column, path: Column) -> Column:
    return F.concat_ws(":", repository, path)


def function_id(repository: Column, path: Column, name: Column, first: Column, last: Column) -> Column:
    return F.concat(repository, F.lit(":"), file_id(repository, path), F.lit(":"), name, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))


def class_id(repository: Column, name: Column) -> Column:
    return F.concat(repository, F.lit(":class:"), name)


def nodes(functions: DataFrame) -> DataFrame:
    """id, label, name of repositories, files, classes and functions; functions: repository, file_path, name, parent_class, start_line, end_line."""
    r, p, n, c = (F.col(x) for x in ("repository", "file_path", "name", "parent_class"))
    pick = lambda label, key, name, rows=functions: rows.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"))
    found = pick("Repository", r, r).unionByName(pick("File", file_id(r, p), p)).unionByName(pick("Class", class_id(r, c), c, functions.filter(c.isNotNull())))
    return found.unionByName(pick("Function", function_id(r, p, n, F.col("start_line"), F.col("end_line")), n)).dropDuplicates(["id", "label"])


def edges(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst, type, full_call: CONTAINS, DECLARES, HAS_METHOD, and CALLS by name (the last function of a name).

    calls: seq of the caller, callee (a name), full_call. Calls of unknown names have type EXTERNAL_CALL and the name as dst.
    """
    r, p, c = (F.col(x) for x in ("repository", "file_path", "parent_class"))
    fid = function_id(r, p, F.col("name"), F.col("start_line"), F.col("end_line"))
    f = functions.withColumn("fid", fid)
    edge = lambda rows, a, b, kind: rows.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("full_call"))
    out = edge(f, r, file_id(r, p), "CONTAINS").unionByName(edge(f, file_id(r, p), F.col("fid"), "DECLARES"))
    out = out.unionByName(edge(f.filter(c.isNotNull()), class_id(r, c), F.col("fid"), "HAS_METHOD"))
    target = resolve_names(f.withColumn("id", F.col("fid"))).select(F.col("name").alias("callee"), F.col("id").alias("target"))
    made = calls.join(f.select("seq", "fid"), "seq").join(target, "callee", "left")
    kind = F.when(F.col("target").isNull(), "EXTERNAL_CALL").otherwise("CALLS")
    return out.unionByName(made.select(F.col("fid").alias("src"), F.coalesce("target", "callee").alias("dst"), kind.alias("type"), "full_call")).distinct()


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of nodes or edges as one: a row for each key, with the new row's values and, where they are null or
    absent, the old one's. Keys that repeat within a table count once, with the largest values."""
    both = list(dict.fromkeys([*old.columns, *new.columns]))
    rest = [c for c in both if c not in keys]
    one = lambda df, side: df.groupBy(*keys).agg(*[F.max(c).alias(f"{c}_{side}") for c in rest if c in df.columns], F.lit(True).alias(f"in_{side}"))
    joined = one(old, "old").join(one(new, "new"), keys, "full_outer")
    value = lambda c: F.coalesce(*[F.col(f"{c}_{side}") for side, df in (("new", new), ("old", old)) if c in df.columns]).alias(c)
    return joined.select(*keys, *[value(c) for c in rest]).select(*both)


def graph_of_index(rows: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a vector index. rows: vec_id, name, file_path, parent_class; calls: src, dst (vec_id).

    Nodes: Function, File and Class by their keys. Edges: CONTAINS (file, function), HAS_METHOD (class, function), CALLS.
    """
    f, p, c = (F.col(x) for x in ("vec_id", "file_path", "parent_class"))
    fid = F.concat(F.lit("function:"), f.cast("string"))
    file, cls = F.concat(F.lit("file:"), p), F.concat_ws(":", F.lit("class"), p, c)
    node = lambda df, key, label, name: df.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"))
    found = node(rows, fid, "Function", F.col("name")).unionByName(node(rows.filter(p.isNotNull()), file, "File", p)).unionByName(node(rows.filter(c.isNotNull()), cls, "Class", c))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    links = edge(rows.filter(p.isNotNull()), file, fid, "CONTAINS").unionByName(edge(rows.filter(c.isNotNull()), cls, fid, "HAS_METHOD"))
    named = lambda x: F.concat(F.lit("function:"), F.col(x).cast("string"))
    return found.distinct(), links.unionByName(edge(calls, named("src"), named("dst"), "CALLS")).distinct()
