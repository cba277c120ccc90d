"""Complexity scores with fixed or adaptive weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import floor_quantiles
from .ranges import running_total

# Weight of each measure in the default score, and the score from which a level begins.
WEIGHTS = {"cyclomatic_complexity": 0.4, "lines_of_code": 0.01, "branch_count": 0.3, "parameters": 0.1}
SIMPLE, MODERATE = 10, 25


def default_score(weights: dict[str, float] | None = None) -> Column:
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in (weights or WEIGHTS).items()), F.lit(0.0))


def level(score: Column) -> Column:
    return F.when(score < SIMPLE, "simple").when(score < MODERATE, "moderate").otherwise("complex")


def scored(functions: DataFrame) -> DataFrame:
    """id, score, level by fixed weights."""
    score = F.round(default_score(), 6)
    return functions.select("id", score.alias("score"), level(score).alias("level"))


def percentile_rank(scores: DataFrame) -> DataFrame:
    """id, percentile: share of the scores that are no larger, in percent.

    Cumulative counts over different scores, joined back.
    """
    counts = running_total(scores.groupBy("score").agg(F.count("*").alias("c")), [F.col("score")], F.col("c"), "upto")
    n = scores.count()
    return scores.join(counts.select("score", "upto"), "score").select("id", F.round(F.col("upto") * 100.0 / max(n, 1), 6).alias("percentile"))


# The weight of each measure by how far it spreads in the population, the first limit that is passed.
SPREAD = {
    "cyclomatic_complexity": ((20, 0.5), (10, 0.4), (None, 0.3)),
    "lines_of_code": ((50, 0.02), (20, 0.015), (None, 0.01)),
    "branch_count": ((10, 0.35), (5, 0.3), (None, 0.25)),
    "parameters": ((5, 0.15), (2, 0.1), (None, 0.05)),
}


def adaptive_weights(functions: DataFrame) -> dict[str, float]:
    """The weight of each measure, in all 1, by its range (cyclomatic complexity) or sample deviation over positive values."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    spread = {c: F.max(positive(c)) - F.min(positive(c)) if c == "cyclomatic_complexity" else F.stddev_samp(positive(c)) for c in SPREAD}
    row = functions.agg(*[F.coalesce(x, F.lit(0.0)).alias(c) for c, x in spread.items()]).first()
    raw = {c: next(w for limit, w in rules if limit is None or row[c] > limit) for c, rules in SPREAD.items()}
    return {c: w / sum(raw.values()) for c, w in raw.items()}


def adaptive(functions: DataFrame) -> DataFrame:
    """id, score, level: scores by adaptive weights; levels by the quartiles that the fixed weights' scores have."""
    fixed = floor_quantiles(functions.select(F.round(default_score(), 6).alias("v")), {"p25": 0.25, "p75": 0.75})
    score = F.round(default_score(adaptive_weights(functions)), 6)
    by_quartile = F.when(F.col("score") <= F.col("p25"), "simple").when(F.col("score") <= F.col("p75"), "moderate").otherwise("complex")
    return functions.select("id", score.alias("score")).crossJoin(F.broadcast(fixed)).select("id", "score", by_quartile.alias("level"))  # one row is broadcast


def skipped(functions: DataFrame) -> DataFrame:
    """id, score, level of functions that are not to be scored."""
    return functions.select("id", F.lit(15.0).alias("score"), F.lit("moderate").alias("level"))
