"""Functions, classes and imports of a source text by patterns, without a parser, and names of JavaScript functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running

# The patterns. Groups hold the name.
PYTHON_FUNCTION = r"def\s+(\w+)\s*\([^)]*\):"
PYTHON_CLASS = r"class\s+(\w+)(?:\([^)]*\))?:"
PYTHON_IMPORT = r"(?:from\s+\S+\s+)?import\s+([^\n]+)"
SCRIPT_FUNCTION = r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>)"
SCRIPT_CLASS = r"class\s+(\w+)"
SCRIPTS = ("javascript", "typescript")
# Objects of a browser whose members are no functions of a file.
GLOBALS = ("document", "console", "navigator", "location", "history", "screen", "global", "self")


def named_lines(text: Column, pattern: str, groups: int = 1) -> Column:
    """Array of (name, line): matches of a pattern with the line that each begins in, counted from 1.

    The text is cut at its matches; a match begins as many lines down as the pieces and matches before it have breaks.
    """
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    name = lambda m: F.coalesce(*[F.nullif(F.regexp_extract(m, pattern, g), F.lit("")) for g in range(1, groups + 1)])

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), breaks)
        before = running(F.zip_with(gaps, found, lambda g, m: g + breaks(m)), F.lit(0), lambda a, b: a + b)
        lines = F.zip_with(gaps, before, lambda g, n: g + n + 1)
        return F.zip_with(found, lines, lambda m, line: F.struct(name(m).alias("name"), line.cast("int").alias("line")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def structure(content: Column, language: Column) -> Column:
    """STRUCT<functions, classes, imports>: (name, line) of functions and classes, and what is imported, in their order.

    Python, JavaScript and TypeScript; empty for other languages.
    """
    text, python, script = F.coalesce(content, F.lit("")), language == "python", language.isin(*SCRIPTS)
    none = F.array().cast("array<struct<name:string,line:int>>")
    functions = F.when(python, named_lines(text, PYTHON_FUNCTION)).when(script, named_lines(text, SCRIPT_FUNCTION, 2)).otherwise(none)
    classes = F.when(python, named_lines(text, PYTHON_CLASS)).when(script, named_lines(text, SCRIPT_CLASS)).otherwise(none)
    imports = F.when(python, F.transform(F.regexp_extract_all(text, F.lit(PYTHON_IMPORT), F.lit(1)), F.trim)).otherwise(F.array().cast("array<string>"))
    return F.struct(functions.alias("functions"), classes.alias("classes"), imports.alias("imports"))


def no_script_function(name: Column) -> Column:
    """Whether a JavaScript name is none of a function of the file: members of globals, odd brackets, quotes, deep paths."""
    count = lambda c: F.length(name) - F.length(F.replace(name, F.lit(c), F.lit("")))
    has = lambda c: F.contains(name, F.lit(c))
    member = F.lit(False)
    for known in ("window", *GLOBALS):
        member = member | name.startswith(f"{known}[") | name.startswith(f"{known}.")
    brackets = has("[") & has("]") & ((count("[") != 1) | (count("]") != 1))
    dollar = name.startswith("$") & (F.length(name) > 1)
    return name.isNull() | (name == "") | member | brackets | (count(".") > 1) | dollar | has("'") | has('"') | has("`")
