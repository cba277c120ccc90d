"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time, the words of its source up to and with it, in a shuffled order, divided by
the source's weight. All documents sorted by that time and cut at the total budget are a mix in which each source has
its share; a source that runs out after its last permitted repeat leaves its share to the others.

No step gathers a source: running sums are taken in buckets of the shuffled order, and the bucket sums, a few bytes for
each bucket, are summed in turn. The cut is found on histograms of the finish time, so the only rows that are sorted in
one task are those of the one bucket that holds it.

Edge cases: a null text has size 0 and is mixed like an empty one; documents of size 0 finish with the document before
them; a null source is a source of its own and comes last; repeated rows are separate documents that happen to be
equal; an empty table gives an empty mix. Columns of the input are carried in a struct, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

from .text import word_count

#: Rows that the bucket of the cut should hold.
BUCKET_ROWS = 50_000


def _content(text: str, source: str) -> Column:
    """Tells apart the rows that share an id."""
    return F.xxhash64(text, source, F.col(text).isNull(), F.col(source).isNull())


def ranked_sources(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row for each source with its size and weight; weights repeat over the sources by code point, null last.

    The rank is the place within a range partition plus the rows of the partitions before, so the sources themselves
    are never in one task.
    """
    order = [F.col("no_source"), F.col("source")]
    totals = sizes.groupBy("source", "no_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    parts = materialize(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = (
        parts.groupBy("part").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("part", F.coalesce("before", F.lit(0)).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    return (
        parts.withColumn("place", place).join(before, "part")
        .withColumn("weight", F.get(kinds, ((F.col("place") + F.col("before")) % len(weights)).cast("int")))
        .select("source", "no_source", "source_size", "n_docs", "weight")
    )


def fill_level(sources: DataFrame, budget: float, cap: float) -> float:
    """The level V at which sum(min(cap * size, weight * V)) is the budget; infinite if all sources are exhausted."""
    full = lambda level: F.col("source_size") * cap <= F.col("weight") * level
    level = 0.0
    while True:
        at = F.lit(level)
        fixed, free, n = sources.agg(
            F.coalesce(F.sum(F.when(full(at), F.col("source_size") * cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full(at), F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full(at), 1)),
        ).first()
        if not free:
            return math.inf
        found = (budget - fixed) / free
        if found <= level:
            return level
        level = found


def _narrowed(queue: DataFrame, by: Column, rows: int, left: float) -> tuple[DataFrame, int, float]:
    """The part of the queue, by one key, in which its running size passes `left`; its rows, and what is left for it.

    Each round splits the range that holds the place into buckets, until its rows are few or share one value.
    """
    low, high = queue.agg(F.min(by), F.max(by)).first()
    while rows > BUCKET_ROWS and high > low:
        n = min(100_000, max(64, rows // BUCKET_ROWS * 4))
        step = (high - low) / n
        if not step:
            break
        slot = F.least(F.lit(n - 1), F.floor((by - low) / step)).cast("long")
        inside = queue.filter(by.between(low, high))
        counts = inside.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min(by).alias("low"), F.max(by).alias("high"))
        found = counts.withColumn("upto", F.sum("size").over(Window.orderBy("slot"))).filter(F.col("upto") > left).orderBy("slot").first()
        left -= found["upto"] - found["size"]
        rows, low, high = found["rows"], found["low"], found["high"]
    return queue.filter(by.between(low, high)), rows, left


def _cut(queue: DataFrame, budget: float) -> tuple[float, int] | None:
    """Finish time and tie of the last queued row that fits the budget; None if all of them do.

    queue: finish, tie, size. Rows of one finish time are told apart by their ties, which are hashes.
    """
    rows, total = queue.agg(F.count("*"), F.sum("size")).first()
    if not rows or total <= budget:
        return None
    tail, rows, left = _narrowed(queue, F.col("finish"), rows, budget)
    if rows > BUCKET_ROWS:
        tail, rows, left = _narrowed(tail, F.col("tie").cast("double"), rows, left)
    placed = tail.withColumn("upto", F.sum("size").over(Window.orderBy("finish", "tie")))
    last = placed.filter(F.col("upto") <= left).orderBy(F.desc("finish"), F.desc("tie")).select("finish", "tie").first()
    if last:
        return last[0], last[1]
    first = tail.orderBy("finish", "tie").select("finish", "tie").first()  # the row before it is the last that fits
    return (first[0], first[1] - 1) if first[1] > -(2**63) else (math.nextafter(first[0], -math.inf), 2**63 - 1)


@dataclass(frozen=True)
class Queue:
    """rows: doc_id, source, size, source_size, target, weight, running, place, content for each document."""

    rows: DataFrame
    cap: float
    cut: tuple[float, int] | None

    @property
    def epochs(self) -> int:
        return math.ceil(self.cap)

    @staticmethod
    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("running")) / F.col("weight")

    @staticmethod
    def tie(epoch: Column) -> Column:
        return F.xxhash64("place", "source", epoch.cast("int"))

    def allowed(self, epoch: Column) -> Column:
        """Whether a pass over the source may reach the document under the cap."""
        return epoch * F.col("source_size") + F.col("running") <= F.col("source_size") * F.lit(float(self.cap))

    def taken(self, epoch: Column) -> Column:
        """Whether the mix has the document in this pass."""
        if self.cut is None:
            return self.allowed(epoch)
        at, tie = F.lit(self.cut[0]), F.lit(self.cut[1])
        first = self.finish(epoch)
        return self.allowed(epoch) & ((first < at) | ((first == at) & (self.tie(epoch) <= tie)))

    def passes(self) -> Column:
        """Number of passes that take the document."""
        return sum((F.when(self.taken(F.lit(e)), 1).otherwise(0) for e in range(self.epochs)), F.lit(0)).cast("long")


def fair_queue(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> Queue:
    """Every document with its place in the queue, and the cut.

    share: budget as a part of all words. cap: most passes over a source; a fraction limits the words of the last pass.
    weights: given to the sources by code point, null last, and repeated; a target stops at cap times the source's
    size, and the excess goes to the other sources by weight.
    """
    sizes = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("real_source"), word_count(F.col(text)).alias("size"), _content(text, source).alias("content")).select(
            "doc_id", "content", F.coalesce("real_source", F.lit("")).alias("source"), F.col("real_source").isNull().alias("no_source"), "size",
            F.xxhash64(F.lit(seed), "doc_id", "content").alias("place"),
        ),
        "sizes",
    )
    sources = materialize(ranked_sources(sizes, weights), "weights")
    rows, words = sources.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget = share * words
    level = fill_level(sources, budget, cap) if words else 0.0
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(level)) if level < math.inf else F.col("source_size") * F.lit(float(cap))
    buckets = math.isqrt(rows) + 1  # as many as the rows in each, so that neither grows like the table
    sizes = sizes.withColumn("bucket", F.pmod(F.shiftright("place", 20), F.lit(buckets)))
    sums = sizes.groupBy("source", "no_source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source", "no_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    within = Window.partitionBy("source", "no_source", "bucket").orderBy("place", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queue = (
        sizes.withColumn("own", F.sum("size").over(within))
        .join(sums, ["source", "no_source", "bucket"])
        .join(sources.withColumn("target", target), ["source", "no_source"])
        .select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "weight", (F.col("own") + F.col("before")).alias("running"), "place", "content")
    )
    queue = materialize(queue, "queue")
    found = Queue(queue, cap, None)
    epoch = F.col("epoch")
    spread = queue.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(found.epochs - 1)))).filter(found.allowed(epoch))
    return Queue(queue, cap, _cut(spread.select(found.finish(epoch).alias("finish"), found.tie(epoch).alias("tie"), "size"), budget))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each time that the mix has the document, by finish time.

    Repeated rows of the input share one decision.
    """
    queue = fair_queue(docs, weights, share, cap, seed, doc_id, text, source)
    epochs = F.filter(F.sequence(F.lit(0), F.lit(queue.epochs - 1)), lambda e: queue.taken(e))
    times = F.transform(epochs, lambda e: F.struct(queue.finish(e).alias("finish"), queue.tie(e).alias("tie")))
    decided = queue.rows.select("doc_id", "content", times.alias("times")).filter(F.size("times") > 0)
    decided = decided.groupBy("doc_id", "content").agg(F.max("times").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), _content(text, source).alias("content"))
    joined = rows.alias("r").join(decided.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.content") == F.col("d.content")))
    at = joined.select("row", F.explode("times").alias("at"))
    return at.orderBy("at.finish", "at.tie").select("row.*")
