"""Array expressions that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element, op over all elements before it (zero for the first), in n * sqrt(n) steps for n elements.

    zero must change nothing under op. An array that grows by one element is copied each time, so results are made in blocks of the square root of n.
    """

    def inside(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out")), step, lambda acc: acc["out"])

    def blocked(array: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(array))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(array), size), lambda i: F.slice(array, i, size))
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, op))
        return F.flatten(F.zip_with(blocks, inside(totals, zero), inside))

    return let(values, lambda array: F.when(F.size(array) > 0, blocked(array)).otherwise(F.slice(F.array(zero), 1, 0)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
