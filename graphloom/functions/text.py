"""Features of code and paths as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language, for the languages that extensions tell apart.
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".java": "java",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "typescript",
    ".cs": "c_sharp", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".php": "php", ".php3": "php", ".php4": "php", ".php5": "php", ".phtml": "php",
    ".swift": "swift", ".scala": "scala", ".sc": "scala", ".lua": "lua", ".r": "r", ".R": "r",
    ".ex": "elixir", ".exs": "elixir",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".fish": "bash",
    ".proto": "proto", ".ql": "codeql", ".qll": "codeql", ".star": "starlark", ".bzl": "starlark",
}
# The languages of files that are indexed for search (extensions in any case, else unknown).
INDEX_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}
# The languages of functions that are described (else python).
DESCRIBED_LANGUAGES = {".py": "python", ".java": "java", ".c": "c", ".h": "c", ".js": "javascript", ".ts": "typescript"}


def repo_name(url: Column) -> Column:
    """Last part of a URL's path without its extension."""
    path = F.regexp_extract(url, "^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?/*$", 1)


def clone_url(line: Column) -> Column:
    """The line of a repository list as a URL that ends in .git."""
    url = F.trim(line)
    return F.when(url.endswith(".git"), url).otherwise(F.concat(url, F.lit(".git")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """With the dot, or empty; a leading dot makes none."""
    return F.regexp_extract(basename(path), r".(\.[^.]+)$", 1)


def language(path: Column, mapping: dict[str, str] | None = None, default: str = "unknown", fold: bool = False) -> Column:
    """Language by extension. fold: extensions in any case."""
    ext = F.lower(extension(path)) if fold else extension(path)
    table = F.create_map(*[F.lit(x) for pair in (mapping or LANGUAGES).items() for x in pair])
    return F.coalesce(table[ext], F.lit(default))


def _has(text: Column) -> Callable[[str], Column]:
    return lambda part: F.contains(text, F.lit(part))


def file_type(path: Column) -> Column:
    """The first of these rules that holds, in the path as it is."""
    has = _has(path)
    python = F.when(has("__init__.py"), "package_init").when(has("setup.py"), "setup").when(has("requirements"), "requirements").otherwise("module")
    return (
        F.when(path.endswith("_test.py") | has("test_"), "test").when(path.endswith(".py"), python)
        .when(path.endswith(".md"), "documentation").when(path.endswith(".json"), "configuration").otherwise("other")
    )


def function_type(name: Column, code: Column) -> Column:
    """The first of these rules that holds."""
    has = _has(code)
    return (
        F.when(name.startswith("test"), "test").when(name.startswith("__") & name.endswith("__"), "magic_method").when(name.startswith("_"), "private")
        .when(has("async def"), "async").when(has("yield"), "generator").when(has("@") & has("def"), "decorated")
        .when(has("def ") & has("(") & has(")") & has("return"), "decorator").otherwise("regular")
    )


def function_flags(kind: Column) -> dict[str, Column]:
    """is_async, is_generator, is_decorator, is_test: the one that the type has won by."""
    return {f"is_{name}": kind == name for name in ("async", "generator", "decorator", "test")}


def content_type(name: Column, content: Column) -> Column:
    """The type of a function that is indexed for search: the first of these rules that holds."""
    has = _has(content)
    return (
        F.when(F.contains(F.lower(name), F.lit("test")), "test").when(has("async") | has("await"), "async").when(has("@") & has("def"), "decorator")
        .when(has("class") & has("def"), "method").otherwise("regular")
    )


def content_flags(name: Column, content: Column) -> dict[str, Column]:
    """is_async, is_test, is_decorator of a function that is indexed for search, each by a rule of its own."""
    has = _has(content)
    test = name.startswith("test_") | name.endswith("_test") | has("assert") | has("unittest")
    return {"is_async": has("async def") | has("await"), "is_test": test, "is_decorator": has("@") & has("def")}


def method_type(name: Column, code: Column) -> Column:
    return (
        F.when(name.startswith("__"), "magic").when(name.startswith("_"), "private").when(F.contains(code, F.lit("@staticmethod")), "static")
        .when(F.contains(code, F.lit("@classmethod")), "class").otherwise("instance")
    )


def count_of(text: Column, part: str) -> Column:
    """Number of non-overlapping places where the text has a part."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def heuristic_complexity(text: Column) -> Column:
    """Lines, branches, exceptions and the deepest indent, each with its weight."""
    lines = F.split(text, "\n")
    deepest = F.array_max(F.transform(lines, lambda x: F.when(F.trim(x) != "", F.length(x) - F.length(F.ltrim(x))).otherwise(0)))
    branches = count_of(text, "if ") + count_of(text, "for ") + count_of(text, "while ")
    guards = count_of(text, "try:") + count_of(text, "except")
    return F.round(F.least(F.size(lines) / 10.0, F.lit(2.0)) + 0.5 * branches + 0.3 * guards + F.least(deepest / 4.0, F.lit(2.0)), 2)


# Words in a name that make it important, by tier.
TIERS = ((2.0, ("main", "init", "setup", "config")), (1.5, ("get", "set", "create", "build")), (1.0, ("test", "check", "validate")))
MAIN_GUARD = 'if __name__ == "__main__"'


def heuristic_importance(name: Column, code: Column) -> Column:
    """The first tier of the name, quotes of a docstring, many parameters, a main guard."""
    low, tier, parameters, has = F.lower(name), F, parameter_count(code), _has(code)
    for points, words in TIERS:
        tier = tier.when(low.rlike("|".join(words)), points)
    doc = has('"""') | has("'''")
    return (
        tier.otherwise(0.0) + F.when(doc, 1.0).otherwise(0.0) + F.when(parameters > 5, 1.0).when(parameters > 2, 0.5).otherwise(0.0)
        + F.when(has(MAIN_GUARD), 2.0).otherwise(0.0)
    )


def parameter_count(code: Column) -> Column:
    """Parts between commas, that are not blank, of the first parameter list."""
    inside = F.regexp_extract(code, r"def\s+\w+\s*\(([^)]*)\)", 1)
    return F.size(F.filter(F.split(inside, ","), lambda x: ~x.rlike(r"^\s*$"))).cast("long")


def return_type(code: Column) -> Column:
    """The name behind the first arrow that has one; empty if there is none."""
    return F.regexp_extract(code, r"->\s*(\w+)", 1)


def docstring(code: Column) -> Column:
    """The first text in three double quotes without a double quote in it, else in three single ones; empty if none."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    double, single = (F.regexp_extract(code, f"{q}{q}{q}([^{q}]*){q}{q}{q}", 1) for q in ('"', "'"))
    return F.when(_has(code)('"""'), strip(double)).otherwise(strip(single))


def comment_summary(comment: Column) -> Column:
    """A comment without its markers, 50 characters."""
    return F.substring(F.regexp_replace(comment, r"^[/#*\s]+|[*/\s]+$", ""), 1, 50)


def embedding_text(**parts: Column) -> Column:
    """Labelled lines; nulls are left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in parts.items()])


def unique_key(name: Column, path: Column, parent_class: Column) -> Column:
    """name::stem::class; without a class, a hash of the path; at most 100 characters."""
    stem = F.regexp_replace(basename(path), r"\.[^.]+$", "")
    key = F.concat_ws("::", name, stem, F.coalesce(parent_class, F.substring(F.md5(path.cast("binary")), 1, 8)))
    return F.substring(key, 1, 100)


def highlights(content: Column, query: str, around: int = 3, most: int = 3, size: int = 200) -> Column:
    """Lines with the query in any case and the lines around, cut to a size, the first few."""
    lines = F.split(content, "\n")
    low = F.lit(query.lower())
    hits = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.contains(F.lower(F.get(lines, i)), low))

    def passage(i: Column) -> Column:
        first = F.greatest(i - around, F.lit(0))
        text = F.array_join(F.slice(lines, first + 1, i + around + 1 - first), "\n")
        return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)

    return F.transform(F.slice(hits, 1, most), passage)


def keywords(query: Column, dictionary: list[str]) -> Column:
    """Dictionary words that a query has in it, then its own words of three letters or more, each once."""
    low = F.lower(query)
    known = F.filter(F.array(*map(F.lit, dictionary)) if dictionary else F.array().cast("array<string>"), lambda w: F.contains(low, w))
    own = F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.array_distinct(F.concat(known, own))


def keyword_score(query: str, name: Column, path: Column, content: Column, doc: Column) -> Column:
    """0.8 for the name, 0.6 for the path, 0.4 for the content, 0.7 for the docstring that has the query in it."""
    low = F.lit(query.lower())
    hit = lambda c, points: F.when(F.contains(F.lower(c), low), F.lit(points)).otherwise(F.lit(0.0))
    return hit(name, 0.8) + hit(path, 0.6) + hit(content, 0.4) + hit(doc, 0.7)


def graph_score(importance: Column, complexity: Column, kind: Column, parent_class: Column) -> Column:
    """What the graph knows of a function, from 0 to 1; missing values count little."""
    return F.least(
        F.lit(1.0),
        F.when(importance > 0, F.least(importance / 10, F.lit(1.0)) * 0.4).otherwise(0.1) + F.when(complexity > 0, F.least(complexity / 20, F.lit(1.0)) * 0.3).otherwise(0.05)
        + F.when(kind.isin("test", "async", "decorator"), 0.1).otherwise(0.0) + F.when(parent_class.isNotNull(), 0.1).otherwise(0.0) + F.when(kind == "test", 0.1).otherwise(0.0) + 0.05,
    )
