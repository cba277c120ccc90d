"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of hashed words is trained from confirmed toxic texts and from unlabelled texts. The
risk of calling a clean text toxic is estimated on the unlabelled texts, less the share of it that the class prior gives to
toxic ones; when that difference falls below zero, which only overfitting brings about, the step climbs back. The
logistic loss makes the score a probability.

Labels are read from rows of the training folds alone. The fit takes at most `max_positive` toxic and `max_unlabelled`
unlabelled texts, those with the smallest hashes of their ids; the class prior comes from all labels of the training
folds. Scoring covers every whole text.

Edge cases: a null text is empty, and an empty text's score is that of no word at all; a null doc_id is in no held-out
fold; without toxic labels every score is 0; repeated rows get equal results; an empty table gives an empty result.
Features come from the text alone, so no other column can clash or leak.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

from .features import Adam, Rows, distinct_words, sigmoid, total

BITS = 24


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -np.inf

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        return float(sigmoid(self.bias + total(self.weights, distinct_words(text, BITS))))


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from: rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def slopes(z: np.ndarray, marked: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Slope for each row's sum z of the step to take, and the risk of calling clean texts toxic, as estimated.

    The whole risk is that of calling confirmed texts clean, times the prior, and the risk of calling clean texts toxic:
    the unlabelled texts' share of it less the prior times the confirmed ones'. While the latter is below zero, the step
    climbs it alone.
    """
    p, n = int(marked.sum()), len(marked)
    chance, clean_loss = sigmoid(z), np.logaddexp(0, z)
    clean_risk = float(clean_loss[~marked].mean() - prior * clean_loss[marked].mean())
    slope = np.empty(n)
    slope[marked], slope[~marked] = -prior * chance[marked] / p, chance[~marked] / (n - p)
    if clean_risk < 0:
        slope = -slope
    else:
        slope[marked] += prior * (chance[marked] - 1) / p
    return slope, clean_risk


def train(rows: Rows, marked: np.ndarray, prior: float, rate: float = 0.1, steps: int = 400, shrink: float = 1e-4) -> Model:
    """Minimise the non-negative risk over rows of distinct feature numbers; marked: which rows are confirmed toxic."""
    p = int(marked.sum())
    if not p or p == rows.n:
        return Model()
    names = rows.select(marked.astype(float), 3.5, 3)
    weights, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    of_weights, of_bias = Adam(len(names), rate), Adam(1, rate)
    for _ in range(steps):
        slope, _ = slopes(rows.times(weights) + bias, marked, prior)
        weights -= of_weights.step(rows.gather(slope, len(names)) + shrink * weights)
        bias -= float(of_bias.step(np.array([slope.sum()]))[0])
    # the unlabelled texts are toxic as often as the prior says
    z, low, high = rows.times(weights)[~marked], -30.0, 30.0
    for _ in range(60):
        bias = (low + high) / 2
        low, high = (bias, high) if sigmoid(z + bias).mean() < prior else (low, bias)
    return Model(dict(zip(names.tolist(), weights.tolist(), strict=True)), bias)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(distinct_words(t, BITS), "<i4").tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["marked"], pa.array(found, pa.binary())], names=["doc_id", "marked", "features"])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 9000, seed: int = 0, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labels of the training folds. max_positive, max_unlabelled: most texts that the fit takes."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    toxic, n = known.agg(F.count_if(F.col("label") == 1), F.count("*")).first()
    if not toxic:
        return Model()
    prior = min(0.99, toxic / n)
    order = F.xxhash64(F.lit(seed), "doc_id")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    positive = known.filter("label = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive)
    others = texts.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    # at most max_positive + max_unlabelled ids
    chosen = materialize(positive.withColumn("marked", F.lit(True)).unionByName(others.withColumn("marked", F.lit(False))), "sample")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "marked", "text")
    found = sample.mapInArrow(_features, f"doc_id {dict(sample.dtypes)['doc_id']}, marked boolean, features binary")
    # of rows that share an id, one text counts: that with the smallest features
    table = found.groupBy("doc_id", "marked").agg(F.min("features").alias("features")).select("marked", "features").toArrow()
    return train(Rows.of_bytes(table["features"]), table["marked"].to_numpy().astype(bool), prior)


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.score(t.as_py()) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    scored = rows.mapInArrow(lambda b: _score(b, model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
