"""Texts as vectors: hashed words and word pairs, weighed by how rare they are."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame


def embedder(size: int = 10_000, text: str = "content", vocabulary: bool = False) -> Pipeline:
    """A pipeline of native steps: words without stop words, with word pairs, as `size` components of length 1.

    vocabulary: a component for each of the most frequent terms; else terms are hashed to components.
    """
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="words_", pattern=r"\w\w+", gaps=False),
            StopWordsRemover(inputCol="words_", outputCol="kept_"),
            NGram(n=2, inputCol="kept_", outputCol="pairs_"),
            SQLTransformer(statement="SELECT *, concat(kept_, pairs_) AS terms_ FROM __THIS__"),
            CountVectorizer(vocabSize=size, inputCol="terms_", outputCol="counts_") if vocabulary else HashingTF(numFeatures=size, inputCol="terms_", outputCol="counts_"),
            IDF(inputCol="counts_", outputCol="weights_"),
            Normalizer(inputCol="weights_", outputCol="features_"),
        ]
    )


def embed(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with `embedding`; null texts must be replaced before."""
    done = model.transform(rows)
    return done.select(*rows.columns, vector_to_array("features_").alias("embedding"))
