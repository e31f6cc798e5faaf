"""The order that rows had at their source: restored after joins and shuffles, or as gapless numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import written


def restored(df: DataFrame, place: str = "row_place") -> DataFrame:
    """Rows in the order of their place, which is dropped: partitions by range, each sorted. What is written or collected
    from it is in order."""
    return df.orderBy(place).drop(place)


def indexed(df: DataFrame, place: str = "row_place", out: str = "row_index") -> DataFrame:
    """Rows in the order of their place with gapless numbers from 0, in a column that replaces the place.

    No task has all rows: they are sorted by range and written with their partition and a number in it; the sizes of the
    partitions before it (a row for each partition, so they are broadcast) are added when they are read again. Ties are
    numbered as they come.
    """
    part, own = "order_part", "order_own"
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = written(df.orderBy(place).select(*(c for c in df.columns if c != place), F.spark_partition_id().alias(part), low.alias(own)), "ordered")
    sizes = sorted_rows.groupBy(part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sizes = F.broadcast(sizes.select(part, before.alias("before")))
    return sorted_rows.join(sizes, part).withColumn(out, F.col(own) + F.col("before")).drop(part, own, "before")
