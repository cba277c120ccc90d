"""Search history as a stream: windowed counts with late data, sessions, duplicates dropped, incremental indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.hybrid import changes, newest
from graphloom.session import discard, materialize, shared_path


def read_history(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 8) -> DataFrame:
    """Event files as they arrive in a folder, with ts as a timestamp."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total_value per window; events later than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total_value"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop, n: runs of a user's events without a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, as far as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there, and return the result from the shared folder. Each batch replaces (complete) or adds."""
    spark = stream.sparkSession
    out, marks = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own files
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def reindex_batches(stream: DataFrame, index: Callable[[], DataFrame | None], save: Callable[[DataFrame], None], key: str = "path", mark: str = "hash", version: str | None = None):
    """A writer that, for each batch of (key, mark, ...), replaces in the index the rows that are new or changed.

    Of a batch's rows of one key the one with the largest version counts. The table that an earlier batch wrote is
    deleted when its successor is saved.
    """
    written: list[DataFrame] = []

    def replace(rows: DataFrame) -> None:
        table = materialize(rows, "index")
        save(table)
        for before in written:
            discard(before)
        written[:] = [table]

    def put(batch: DataFrame, number: int) -> None:
        batch = newest(batch, [key], version)
        old = index()
        if old is None:
            replace(batch)
            return
        wanted = changes(old, batch, key, mark).filter("change != 'deleted'")
        fresh = batch.join(wanted.select(key), key, "left_semi")
        replace(old.join(fresh.select(key), key, "left_anti").unionByName(fresh))

    return stream.writeStream.foreachBatch(put)
