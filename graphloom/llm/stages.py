"""The stages of the corpus pipeline, each (spark, docs, sf_dir) -> documents.

Each begins with what the stage before has left in the driver collected.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import read_table, release

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier than not to have a grade of 1 or more."""
    from .quality import fit, grade_of_labels, select

    release(spark)
    return select(docs, fit(docs, read_table(spark, sf_dir, "labels"), grade_of_labels(), 3))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are equal to an earlier line or one edit apart; those with no word left go."""
    from .line_dedup import dedup_lines

    release(spark)
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 of their five-word shingles, that with the smallest id.

    Documents are alike by their present texts, or by those that the corpus has, of which line dedup may have left a
    part. Candidates come from SimHash by the generalised pigeonhole principle, and those that are further apart than
    its radius from an exact way for the rest; every link is verified on whole sets.
    """
    from .shingles import keep_one

    release(spark)
    try:
        source = read_table(spark, sf_dir, "documents")
    except AnalysisException as missing:  # there is no corpus but the documents given
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        source = None
    return keep_one(docs, source)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, 150 % of all words, no document more than twice."""
    from .mixing import mix

    release(spark)
    return mix(docs, (5, 2, 1), 1.5, 2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of each row of the mix, and whether the ids decode to the text."""
    import public_tokenizers

    from .bpe import encode_checked

    release(spark)
    return encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
