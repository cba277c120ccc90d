"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with its place (from 0) in the given order, written to the shared folder.

    The place is that within a range partition plus the rows of the partitions before, so that one task holds one
    range, and only the partitions' counts meet.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    placed = parts.withColumn("place_", place).join(counts.select("part_", before.alias("before_")), "part_")
    return materialize(placed.withColumn(name, F.col("place_") + F.col("before_")).drop("part_", "place_", "before_"), "ranked")
