"""Covered periods and gaps of time intervals per entity: problem 5.

Two levels, so that an entity with most of the rows is spread over many tasks. Each interval is
clipped to the time shard it starts in and merged there; what reaches beyond the shard is kept
as one number per shard, its reach. A window over the shards of an entity (one row per occupied
shard) carries the furthest reach so far to the shards behind it, where it stitches coverage
across the boundaries: a local gap exists only beyond that reach. Periods of neighbouring shards
then coalesce wherever no gap lies between them. Intervals of any length cost one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 60_000


def _steps(df: DataFrame, entity: Column, start: Column, end: Column, shard: int) -> DataFrame:
    """(entity, s, e, reach): interval starts with the furthest end before them, null at the first.

    Rows are distinct starts with their largest end.
    """
    x = df.select(entity.cast("string").alias("entity"), start.cast("long").alias("s"), end.cast("long").alias("e"))
    x = x.where("entity is not null and s is not null and e is not null and e >= s")
    x = x.groupBy("entity", "s").agg(F.max("e").alias("e"))
    x = x.withColumn("shard", F.floor(F.col("s") / shard)).repartition("entity", "shard")
    local = Window.partitionBy("entity", "shard").orderBy("s")
    x = x.withColumn("reach", F.max("e").over(local.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("rn", F.row_number().over(local))
    shards = x.groupBy("entity", "shard").agg(F.max("e").alias("far"))
    over = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.select("entity", "shard", F.max("far").over(over).alias("carry"))
    return x.join(carry, ["entity", "shard"]).select("entity", "shard", "s", "e", F.greatest("reach", "carry").alias("reach"))


def gaps(df: DataFrame, *, entity: Column, start: Column, end: Column, min_length: int = 1, shard: int = SHARD) -> DataFrame:
    """(entity, gap_start, gap_end): stretches covered by no interval between two that are.

    Intervals are closed and touching ones are joined; those with a null end or start, a null
    entity, or an end before the start cover nothing; an interval of length 0 covers its instant.
    Nothing before the first or after the last interval of an entity is a gap. Repeated rows make
    no difference, an empty table gives an empty result, other columns are ignored.
    """
    x = _steps(df, entity, start, end, shard).where(F.col("s") - F.col("reach") >= max(1, min_length))
    return x.select("entity", F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))


def periods(df: DataFrame, *, entity: Column, start: Column, end: Column, shard: int = SHARD) -> DataFrame:
    """(entity, period_start, period_end): longest stretches covered without a gap; rows as in ``gaps``."""
    x = _steps(df, entity, start, end, shard)
    opens = F.col("reach").isNull() | (F.col("s") > F.col("reach"))
    # periods of one shard first: a start opens a period, the last one takes what reaches out
    local = Window.partitionBy("entity", "shard").orderBy("s")
    x = x.withColumn("opens", opens.cast("int")).withColumn("run", F.sum(opens.cast("int")).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy("entity", "shard", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("opens").alias("opens"))
    # run 0 continues a period of an earlier shard; one row per shard and period is left to coalesce
    edge = Window.partitionBy("entity", "shard")
    x = x.withColumn("edge", (F.col("run") == 0) | (F.col("run") == F.max("run").over(edge)))
    x = x.withColumn("part", F.when(~F.col("edge"), F.col("s")))
    whole = Window.partitionBy("entity", "part").orderBy("shard", "run")
    x = x.withColumn("period", F.sum("opens").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy("entity", "part", "period").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"))
    return x.select("entity", "period_start", "period_end")
