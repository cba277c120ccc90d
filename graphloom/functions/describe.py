"""Descriptions of functions from their docstrings."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_docstring(text: Column) -> Column:
    """STRUCT<description, args, returns>: the text before the first section, and the sections Args and Returns.

    Other section headers end nothing: their lines stay with the section they are in.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    start = F.struct(F.lit("description").alias("at"), *[F.lit("").alias(k) for k in ("description", "args", "returns")])

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        at = F.when(low.rlike("^(args|arguments|parameters):"), "args").when(low.rlike("^returns?:"), "returns").otherwise(acc["at"])
        rest = F.when(low.rlike("^(args|arguments|parameters|returns?):"), F.trim(F.regexp_replace(line, "^[A-Za-z]+:", ""))).otherwise(line)
        add = lambda k: F.when((at == k) & (rest != ""), F.when(acc[k] == "", rest).otherwise(F.concat(acc[k], F.lit("\n"), rest))).otherwise(acc[k])
        return F.struct(at.alias("at"), *[add(k).alias(k) for k in ("description", "args", "returns")])

    return F.aggregate(lines, start, step, lambda acc: F.struct(*[acc[k].alias(k) for k in ("description", "args", "returns")]))


def describe(functions: DataFrame, client: Callable[[list[str]], list[str]] | None = None, batch: int = 50, attempts: int = 1, wait: float = 1.0) -> DataFrame:
    """seq, docstring (as a struct), has_error: from the functions' own docstrings, or from a client's answers to their code.

    client: takes the code of up to `batch` functions and returns a text for each, or one text with `---` between them. A
    call that fails, or answers for another number of functions, is made again after wait * 1.5 ** try seconds, at most
    180; after the last attempt its batch is marked.
    """
    if client is None:
        return functions.select("seq", split_docstring(F.col("docstring")).alias("docstring"), F.lit(False).alias("has_error"))

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                for attempt in range(attempts):
                    try:
                        told = client(part["code"].tolist())
                        texts, error = [x.strip() for x in told.split("---")] if isinstance(told, str) else list(told), False
                        if len(texts) != len(part):
                            raise ValueError(f"{len(texts)} answers for {len(part)} functions")
                        break
                    except Exception:  # noqa: BLE001 - whatever the client raises, the rows say so
                        texts, error = [None] * len(part), True
                        if attempt < attempts - 1:
                            time.sleep(min(180.0, wait * 1.5**attempt))
                yield pd.DataFrame({"seq": part["seq"], "text": texts, "has_error": error})

    kind = dict(functions.dtypes)["seq"]
    done = functions.select("seq", "code").mapInPandas(run, f"seq {kind}, text string, has_error boolean")
    return done.select("seq", split_docstring(F.col("text")).alias("docstring"), "has_error")
