"""Sums along a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.plans.checkpoints import written


def running_totals(rows: DataFrame, order: list, value: str, name: str, start: int = 0) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row, in an order:
    a range sort, the sum of each part, and the running sum within it. The
    sorted rows are a written table, so both passes see the same parts; what
    is sent to all tasks is one row a part."""
    sorted_rows = rows.orderBy(*order).withColumn("_part", F.spark_partition_id())
    sorted_rows = written(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    parts = sorted_rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    totals = sorted_rows.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + within + start)
    return totals.drop("_part", "_place", "_before")
