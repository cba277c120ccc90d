"""Running totals and row numbers over a whole table without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize


def running_total(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of a value over its rows up to each, in the given order, which must tell all rows apart.

    The sum is that within a range partition plus the sums of the partitions before, so that one task holds one range,
    and only a row for each partition meets the others.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()).withColumn("value_", value), "ranges")
    sums = parts.groupBy("part_").agg(F.sum("value_").alias("sum_"))
    before = F.coalesce(F.sum("sum_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("value_").over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = parts.withColumn("within_", within).join(F.broadcast(sums.select("part_", before.alias("before_"))), "part_")  # as many rows as partitions
    return joined.withColumn(name, F.col("within_") + F.col("before_")).drop("part_", "value_", "within_", "before_")
