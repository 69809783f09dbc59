"""Running sums that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 4096


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = RANGE_ROWS) -> DataFrame:
    """``sum(value) over (partition by keys order by order)`` for an integer ``order`` column.

    The order axis is cut in ranges of ``width``; ranges are summed in parallel,
    the (few) range totals are accumulated, and each range adds its offset. One
    key may therefore hold any share of the rows.
    """
    ranged = df.withColumns({"_range": F.floor(F.col(order) / width).cast("long"), "_value": value})
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, [*keys, "_range"])
        .withColumn(name, F.sum("_value").over(inside) + F.col("_offset"))
        .drop("_range", "_value", "_offset")
    )
