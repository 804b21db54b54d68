"""Ranks and running sums over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], size: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``size`` (or the rows) before each row of its group.

    The order inside a group is ``bucket``, then ``order``, which must tell rows apart. Each
    (group, bucket) is one task's window; what lies before a bucket is a window over bucket sums.
    """
    one = F.lit(1).cast("long") if size is None else F.col(size)
    x = df.withColumn("__one", one)
    totals = x.groupBy(*group, bucket).agg(F.sum("__one").alias("__sum"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(over), F.lit(0))).drop("__sum")
    keys = [*group, bucket]
    totals = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__base")
    cond = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__in", F.coalesce(F.sum("__one").over(local), F.lit(0)))
    return x.join(totals, cond).withColumn(name, F.col("__base") + F.col("__in")).drop("__one", "__base", "__in", *(f"__k{i}" for i in range(len(keys))))
