"""Functions, classes, imports and calls of sources.

Python is parsed by the standard library; a file that does not parse gives no rows. Languages with braces are read by
`braces`. Files of other languages give no rows.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import braces
from .structure import SCRIPTS, no_script_function
from .text import language

FUNCTION = """file_path string, name string, parent_class string, start_line int, end_line int, code string, docstring string, return_type string,
parameters array<struct<name:string,type:string,default:string>>, imports array<string>, calls array<struct<name:string,full_call:string>>,
cyclomatic_complexity int, lines_of_code int, token_count int, branch_count int, syntax_depth int, is_async boolean, decorators array<string>, comments array<string>"""
CLASS = "file_path string, class_name string, bases array<string>, start_line int, end_line int, methods array<string>"

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _own(node: ast.AST) -> Iterator[tuple[ast.AST, int]]:
    """The nodes of a function and their depth, without those of functions within it."""
    left = [(child, 1) for child in ast.iter_child_nodes(node)]
    while left:
        at, depth = left.pop()
        yield at, depth
        if not isinstance(at, (*_DEFS, ast.ClassDef)):
            left += [(child, depth + 1) for child in ast.iter_child_nodes(at)]


def imports_of(tree: ast.AST) -> list[str]:
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found += [f"{'.' * node.level}{node.module or ''}.{a.name}" for a in node.names]
    return list(dict.fromkeys(found))


def _parameters(args: ast.arguments) -> list[dict]:
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    rows = [*zip(plain, defaults, strict=True), *zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    rows += [(a, None) for a in (args.vararg, args.kwarg) if a]
    text = lambda x: None if x is None else ast.unparse(x)
    return [{"name": a.arg, "type": text(a.annotation), "default": text(d)} for a, d in rows]


def comments_of(source: str) -> list[tuple[int, str, bool]]:
    """Line, text and whether nothing else is on the line, of the comments of a Python source, as far as it can be read."""
    found = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                found.append((t.start[0], t.string, not t.line[: t.start[1]].strip()))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return found


def function_row(path: str, source: str, node: ast.FunctionDef, parent: str | None, imports: list[str], comments: list[tuple[int, str, bool]] = ()) -> dict:
    code = ast.get_source_segment(source, node) or ""
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    before = [text for line, text, alone in comments if alone and line == first - 1]
    nodes = list(_own(node))
    branches = sum(isinstance(n, _BRANCHES) for n, _ in nodes)
    bools = sum(len(n.values) - 1 for n, _ in nodes if isinstance(n, ast.BoolOp))
    calls = [n for n, _ in nodes if isinstance(n, ast.Call)]
    name = lambda f: f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
    return {
        "file_path": path, "name": node.name, "parent_class": parent, "start_line": node.lineno, "end_line": node.end_lineno, "code": code, "docstring": ast.get_docstring(node),
        "return_type": None if node.returns is None else ast.unparse(node.returns), "parameters": _parameters(node.args), "imports": imports,
        "calls": [{"name": name(c.func), "full_call": ast.unparse(c)} for c in sorted(calls, key=lambda c: (c.lineno, c.col_offset)) if name(c.func)],
        "cyclomatic_complexity": 1 + branches + bools, "lines_of_code": sum(bool(x.strip()) for x in code.splitlines()), "token_count": len(code.split()), "branch_count": branches,
        "syntax_depth": max((d for _, d in nodes), default=0), "is_async": isinstance(node, ast.AsyncFunctionDef), "decorators": [ast.unparse(x) for x in node.decorator_list],
        "comments": before + [text for line, text, _ in comments if node.lineno <= line <= node.end_lineno],
    }


def parse_source(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """Function rows and class rows of one file, in the order of their lines."""
    kind = braces.language_of(path)
    if kind in braces.BRACED:
        return braces.parse(path, source, kind)
    if kind != "python":
        return [], []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    imports, functions, classes, comments = imports_of(tree), [], [], comments_of(source)
    left: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while left:
        node, parent = left.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFS):
                functions.append(function_row(path, source, child, parent, imports, comments))
                left.append((child, parent))
            elif isinstance(child, ast.ClassDef):
                methods = [x.name for x in child.body if isinstance(x, _DEFS)]
                classes.append({"file_path": path, "class_name": child.name, "bases": [ast.unparse(b) for b in child.bases], "start_line": child.lineno, "end_line": child.end_lineno, "methods": methods})
                left.append((child, child.name))
            else:
                left.append((child, parent))
    by_line = lambda rows: sorted(rows, key=lambda r: r["start_line"])
    return by_line(functions), by_line(classes)


def _parse(which: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (FUNCTION, CLASS)[which].replace("struct<name:string,type:string,default:string>", "p").replace("struct<name:string,full_call:string>", "p").replace("\n", " ").split(", ")]
        for frame in frames:
            rows = [r for path, content in zip(frame["path"], frame["content"], strict=True) for r in parse_source(path, content or "")[which]]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def functions_of(files: DataFrame) -> DataFrame:
    """Function rows of files (path, content as text), and seq: their place by path and line.

    JavaScript names that are members of globals, quoted or deep are left out.
    """
    rows = files.select("path", "content").mapInPandas(_parse(0), FUNCTION)
    rows = rows.filter(~(language(F.col("file_path")).isin(*SCRIPTS, "jsx", "tsx") & no_script_function(F.col("name"))))
    return rows.withColumn("seq", F.concat_ws(":", "file_path", F.lpad(F.col("start_line").cast("string"), 9, "0")))


def classes_of(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_parse(1), CLASS)


def calls_of(functions: DataFrame) -> DataFrame:
    """seq of the caller, callee, full_call, internal: whether a function of that name is known."""
    calls = functions.select("seq", F.explode("calls").alias("c")).select("seq", F.col("c.name").alias("callee"), "c.full_call")
    names = functions.select(F.col("name").alias("callee")).distinct().withColumn("internal", F.lit(True))
    return calls.join(names, "callee", "left").select("seq", "callee", "full_call", F.coalesce("internal", F.lit(False)).alias("internal"))


def large_functions(functions: DataFrame, least: int = 200) -> DataFrame:
    """Functions of more lines than that."""
    return functions.filter(F.col("lines_of_code") > least)


def large_function_counts(functions: DataFrame, least: int = 200) -> DataFrame:
    """One row: n_before and n_after the choice of large functions."""
    return functions.agg(F.count("*").alias("n_before"), F.count_if(F.col("lines_of_code") > least).alias("n_after"))


def complexity_of(functions: DataFrame) -> DataFrame:
    """The functions with their measures in one struct, and the score of complexity times lines over ten."""
    score = (F.col("cyclomatic_complexity") * F.col("lines_of_code") / F.lit(10.0)).alias("complexity_score")
    semantic = F.struct("cyclomatic_complexity", "lines_of_code", F.size("parameters").alias("parameters"), "token_count", score)
    return functions.withColumn("complexity", F.struct(semantic.alias("semantic"), F.struct("branch_count", "syntax_depth").alias("structural")))


def bodies_by_indent(files: DataFrame) -> DataFrame:
    """path, name, start_line, body of each Python function by indentation alone, also where the file does not parse.

    A body ends before the first later line that is not blank and is indented no deeper than its `def`. Each text is
    split once, and a body looks only at the lines after its own head.
    """
    lines = files.select("path", F.split("content", "\n").alias("ls"))
    indent = lambda x: F.when(F.trim(x) != "", F.length(x) - F.length(F.ltrim(x)))
    lines = lines.withColumn("depths", F.transform("ls", indent))
    heads = lines.select("path", "ls", "depths", F.posexplode("ls").alias("first", "line")).filter(F.col("line").rlike(r"^\s*(async )?def\s+\w+\s*\("))
    depth = F.get("depths", F.col("first"))
    after = F.slice("depths", F.col("first") + 2, F.size("ls"))
    stop = F.array_position(F.transform(after, lambda x: F.coalesce(x <= depth, F.lit(False))), True).cast("int")
    size = F.when(stop > 0, stop).otherwise(F.size("ls") - F.col("first"))
    body = F.regexp_replace(F.array_join(F.slice("ls", F.col("first") + 1, size), "\n"), r"\s+$", "")
    return heads.select("path", F.regexp_extract("line", r"def\s+(\w+)", 1).alias("name"), (F.col("first") + 1).alias("start_line"), body.alias("body"))


def last_of_name(functions: DataFrame) -> DataFrame:
    """One row for each name, that with the largest seq."""
    return functions.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))).filter("place = 1").drop("place")
