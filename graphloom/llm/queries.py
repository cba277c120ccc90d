"""The queries of this subpackage: one for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import materialize, read_table

from . import oracles


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    from .permutation import search

    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed patterns, and random strings by models trained on what the patterns find and on ordinary names."""
    from .secrets import judged, labelled_samples, spans, spelled, train

    docs = read_table(spark, sf_dir, "documents")
    marks = materialize(spans(docs), "spans")
    found = judged(marks, train(labelled_samples(docs, marks)))
    # a lambda of one argument, as Spark gives the index to a second one, even to one with a default
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))]
    return found.select(
        "doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"),
    )


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then lines in over 20 and 1 % of a host's documents go; under 30 % of the words left is depleted."""
    from .line_frequency import line_frequency_rules

    rated = line_frequency_rules(read_table(spark, sf_dir, "documents"), 20, 0.01, 0.3)
    return rated.drop("host")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the 50k ranks, and the bytes that they decode to."""
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative positive-unlabelled learning from the toxic labels of three folds; every document is scored."""
    from .toxicity import fit, score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")), 0.3)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two or fewer differing bits."""
    from .simhash import simhash_dedup

    return simhash_dedup(read_table(spark, sf_dir, "documents"), 3, 2, 42)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines equal to an earlier line or one edit apart from it; removed: their numbers, from 0."""
    from .line_dedup import line_decisions

    found = line_decisions(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing by weighted fair queueing: weights 5, 2, 1, 150 % of all words, at most two passes."""
    from .mixing import fair_queue

    queue = fair_queue(read_table(spark, sf_dir, "documents"), (5, 2, 1), 1.5, 2.0)
    return queue.rows.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * queue.passes()).alias("taken"), "source"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative-link regression on grades 0 to 2; selected if a grade of 1 or more is likelier than not."""
    from .quality import fit, grade_of_labels, rate

    docs = read_table(spark, sf_dir, "documents")
    rated = rate(docs, fit(docs, read_table(spark, sf_dir, "labels"), grade_of_labels(), 3))
    tail = F.get("tails", F.lit(0))
    return rated.select("doc_id", "expected_grade", tail.alias("good"), F.get("tails", F.lit(1)).alias("best"), (tail >= 0.5).alias("selected"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to archives and read back."""
    from .warc import round_trip

    return round_trip(read_table(spark, sf_dir, "pages"), min_payload=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query of the subpackage by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return {name: sql for name in queries() if (sql := getattr(oracles, name, None))}
