"""Exact running sums without a single-task window.

A window ``ORDER BY`` without ``PARTITION BY`` pulls every row into one task.
``running_sum_desc`` instead range-partitions the rows on the order key
(Spark samples the key, so a hot time range is still split evenly), sums
each range partition, turns the per-partition totals (one row per
partition) into offsets, and finishes with a window *per range partition*.
Every task holds about ``rows / partitions`` rows. The ranged rows are
written once with their partition number: both the totals and the windows
read those files, so both see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logpond.session import written


def running_sum_desc(df: DataFrame, order_cols: list[str], value_col: str,
                     out_col: str = "running", num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over all rows that come before
    or at this row in descending ``order_cols`` order. ``order_cols`` must
    identify a row uniquely (add an id as the last key)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    desc = [F.col(c).desc() for c in order_cols]
    ranged = written(df.repartitionByRange(n, *desc).withColumn("_pid", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_pid").agg(F.sum(value_col).alias("_ptot"))
    # one row per range partition: a tiny single-task window is fine here
    offsets = totals.select(
        "_pid",
        (F.coalesce(F.sum("_ptot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0))).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(*desc).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value_col).over(w))
    # offsets has one row per partition: broadcasting it is size-bounded
    out = local.join(F.broadcast(offsets), "_pid").withColumn(out_col, F.col("_local") + F.col("_off"))
    return out.drop("_pid", "_local", "_off")
