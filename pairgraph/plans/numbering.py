"""Consecutive numbers in sorted order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairgraph.plans.store import materialize


def dense_numbers(values: DataFrame, col: str, name: str = "no") -> DataFrame:
    """(col, name): distinct values numbered from 0 in ascending order.

    Values are dealt by range; each range is numbered by itself and shifted by the rows of the ranges before it.
    The only global order is that of the ranges' counts.
    """
    ranged = values.select(col).distinct().repartitionByRange(col).withColumn("range_no", F.spark_partition_id())
    kept = materialize(ranged, "ranges")  # a range's number is settled by the writing
    counts = kept.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range_no").orderBy(col)) - 1
    return kept.withColumn("own", own).join(starts, "range_no").select(col, (F.col("own") + F.col("start")).cast("long").alias(name))
