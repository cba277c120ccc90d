"""From documents to a tokenised training mix, as stages that hand each other tables of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import stages
from graphloom.session import discard, materialize, read_table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", stages.quality),
    ("line dedup", stages.line_dedup),
    ("near-duplicates", stages.near_duplicates),
    ("mixing", stages.mixing),
    ("tokens", stages.tokens),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again; what a stage has read then goes."""
    docs, written = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(written)
        written = docs
    return docs
