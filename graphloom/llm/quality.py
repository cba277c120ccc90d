"""Quality by cumulative-link regression on graded ratings.

All grades share one weight for each hashed feature of the text; ordered thresholds cut the sum into grades:
P(grade >= k) = sigmoid(sum - threshold k). A document has its expected grade, and is selected by a tail probability.

The fit takes at most `max_rated` rated texts of the training folds, those with the smallest hashes of their ids.
Scoring covers every whole text.

Edge cases: a null text is empty and is scored like a text without words; without ratings, or with one grade alone,
every text has the share of grades that the ratings have, and without any rating all is selected; repeated rows get
equal results; an empty table gives an empty result. Columns of the input are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

from .features import Adam, Rows, sigmoid, text_profile
from .toxicity import held_out

BITS = 22


@dataclass
class Model:
    """thresholds[k - 1]: of P(grade >= k)."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.array([-30.0]))

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of a text."""
        get = self.weights.get
        return sigmoid(sum(get(k, 0.0) * v for k, v in text_profile(text, BITS).items()) - self.thresholds)


def slopes(sums: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the summed log-likelihood of the grades, by each row's sum and by each threshold."""
    one = np.arange(len(grades))
    tail = np.hstack([np.ones((len(grades), 1)), sigmoid(sums[:, None] - cuts), np.zeros((len(grades), 1))])
    low, high = tail[one, grades], tail[one, grades + 1]
    chance = np.maximum(low - high, 1e-9)
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, grades, -low * (1 - low) / chance)
    np.add.at(by_cut, grades + 1, high * (1 - high) / chance)
    return 1 - low - high, by_cut[1:-1]


def train(rows: Rows, grades: np.ndarray, n_grades: int, rate: float = 0.1, steps: int = 300, shrink: float = 1e-4) -> Model:
    """Maximum likelihood with a ridge; thresholds are the first plus sums of exponentials, so they stay ordered."""
    if not len(grades):
        return Model(thresholds=np.full(n_grades - 1, -30.0))
    names = rows.select(grades.astype(float))
    share = np.clip([(grades >= k).mean() for k in range(1, n_grades)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    weights, of_weights, of_raw = np.zeros(len(names)), Adam(len(names), rate), Adam(len(raw), rate / 2)
    for _ in range(steps):
        by_row, by_cut = slopes(rows.times(weights), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])), grades)
        weights -= of_weights.step(-rows.gather(by_row, len(names)) / rows.n + shrink * weights)
        by_raw = -np.cumsum(by_cut[::-1])[::-1] / rows.n
        by_raw[1:] *= np.exp(raw[1:])
        raw -= of_raw.step(by_raw)
    return Model(dict(zip(names.tolist(), weights.tolist(), strict=True)), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_profile(t, BITS) for t in batch["text"].to_pylist()]
        columns = [np.fromiter(f, "<i4", len(f)).tobytes() for f in found]
        values = [np.fromiter(f.values(), "<f4", len(f)).tobytes() for f in found]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], pa.array(columns, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "grade", "columns", "values"])


def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, max_rated: int = 6000, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from the ratings of the training folds. grade: expression over labels, 0 to n_grades - 1, null for none."""
    rated = labels.select(F.col(doc_id).alias("doc_id"), grade.cast("int").alias("grade")).filter("doc_id is not null and grade is not null")
    rated = rated.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = materialize(rated.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rated), "rated")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")  # at most max_rated ids
    found = sample.mapInArrow(_features, f"doc_id {dict(sample.dtypes)['doc_id']}, grade int, columns binary, values binary")
    # of rows that share an id, one text counts: that with the smallest features
    table = found.groupBy("doc_id", "grade").agg(F.min(F.struct("columns", "values")).alias("f")).select("grade", "f.columns", "f.values").toArrow()
    return train(Rows.of_bytes(table["columns"], table["values"]), table["grade"].to_numpy().astype(np.int64), n_grades)


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tails = [model.tails(t.as_py()).tolist() for t in batch["text"]]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(tails, pa.list_(pa.float64()))], names=[*names, "tails"])


def rate(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content (hash of the text), expected_grade, tails (P(grade >= 1), ...) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    rated = rows.mapInArrow(lambda b: _score(b, model), "doc_id long, content long, tails array<double>")
    return rated.withColumn("expected_grade", F.aggregate("tails", F.lit(0.0), lambda a, p: a + p))


def _keep(batches: Iterable[pa.RecordBatch], model: Model, text: str, grade: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([bool(model.tails(t.as_py())[grade - 1] >= least) for t in batch[text]], pa.bool_()))


def select(docs: DataFrame, model: Model, grade: int = 1, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose chance of at least `grade` is at least `least`, with their own columns, in one pass."""
    return docs.mapInArrow(lambda b: _keep(b, model, text, grade, least), docs.schema)


def grade_of_labels() -> Column:
    """0 for poor text, 1 for good text that is toxic, 2 for good text that is not; unknown toxicity counts as none."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce(F.col("toxic"), F.lit(0)))
