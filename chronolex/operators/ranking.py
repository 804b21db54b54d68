"""Ranks over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.shared import materialise


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row in ascending order of some columns, nulls first.

    The rows are range-partitioned over sampled boundaries and written once; each range is ranked
    by itself and moved on by the rows of the ranges before it, one number a partition. Ties are
    ranked in any order: name columns that tell rows apart.
    """
    x = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    x = materialise(x, "ranges")
    before = x.groupBy("__range").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = before.select("__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return x.withColumn("__local", local).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__local")).drop("__range", "__local", "__before")
