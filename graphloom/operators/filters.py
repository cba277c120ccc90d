"""Searches by attribute. Conditions are native expressions, so that they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_name(functions: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Functions of a name, or whose name has it in it, by name, file and seq. An empty name is in every name."""
    hit = F.col("name") == name if exact else F.contains("name", F.lit(name))
    return functions.filter(hit).orderBy("name", "file_path", "seq")


def ranked(functions: DataFrame, condition: Column, by: str = "complexity_score", limit: int = 20) -> DataFrame:
    """The first `limit` functions that meet a condition by a column, largest first, nulls last, ties by id."""
    return functions.filter(condition).orderBy(F.desc_nulls_last(by), "id").limit(limit)


def by_path(functions: DataFrame, part: str, limit: int = 20) -> DataFrame:
    return ranked(functions, F.contains("file_path", F.lit(part)), limit=limit)


def by_complexity(
    functions: DataFrame, min_lines: int | None = None, max_lines: int | None = None, min_complexity: int | None = None, max_complexity: int | None = None, limit: int = 100
) -> DataFrame:
    """All bounds that are given must hold."""
    bounds = [("lines_of_code", min_lines, max_lines), ("cyclomatic_complexity", min_complexity, max_complexity)]
    conditions = [F.col(c) >= low for c, low, _ in bounds if low is not None] + [F.col(c) <= high for c, _, high in bounds if high is not None]
    return ranked(functions, reduce(lambda a, b: a & b, conditions, F.lit(True)), "cyclomatic_complexity", limit)


def by_score(functions: DataFrame, least: float, most: float | None = None, limit: int = 20) -> DataFrame:
    return ranked(functions, (F.col("complexity_score") >= least) & (F.lit(True) if most is None else F.col("complexity_score") <= most), limit=limit)


def any_keyword(rows: DataFrame, keywords: list[str], columns: list[str]) -> DataFrame:
    """Rows with any keyword in any of the columns; keywords are literals, whatever they hold."""
    hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(k.lower())) for k in keywords for c in columns]
    return rows.filter(reduce(lambda a, b: a | b, hits, F.lit(False)))


def metadata(rows: DataFrame, k: int, order: list, mode: str = "pre", **wanted: object) -> DataFrame:
    """The k best rows with the wanted values. mode 'pre' filters first; 'post' filters the k best, which may leave fewer.

    A name that is no column is ignored; min_<column> and max_<column> are bounds.
    """
    conditions = [F.lit(True)]
    for key, value in wanted.items():
        if key in rows.columns:
            conditions.append(F.col(key) == value)
        elif key[:4] in ("min_", "max_") and key[4:] in rows.columns:
            conditions.append(F.col(key[4:]) >= value if key[:4] == "min_" else F.col(key[4:]) <= value)
    condition = reduce(lambda a, b: a & b, conditions)
    return rows.filter(condition).orderBy(*order).limit(k) if mode == "pre" else rows.orderBy(*order).limit(k).filter(condition)
