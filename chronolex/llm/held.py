"""Runs of one label in ordered sequences, with slips: problem 4.

A *held* stretch of a key is a longest possible stretch of positions that begins and ends
with one label and in which never more than ``max_slip`` positions in a row lack it (another
label, a null label or a lost position). Stretches of different labels may interleave.

The positions of a key are cut into blocks, so that a key holding most of the rows is spread
over many tasks. Inside a block only boundary rows are kept: events whose predecessor with the
same label is too far away, or that have no near successor. A lead over the boundaries pairs
starts with ends and the difference of row numbers is the count. Only the stretches touching a
block's edge go through a second, small pass that stitches them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14


def latest_labels(df: DataFrame, key: Column, position: Column, label: Column, version: Column | None, block: int = BLOCK) -> DataFrame:
    """One row (k, b, p, v) for each key and position: the label of its latest version.

    Rows of one version that differ give the largest label; a null version is the oldest.
    Rows without key or position belong nowhere and are left out.
    """
    x = df.select(
        key.cast("string").alias("k"),
        position.cast("long").alias("p"),
        label.alias("v"),
        (F.lit(0) if version is None else version).alias("ver"),
    ).where("k is not null and p is not null")
    x = x.withColumn("b", F.floor(F.col("p") / block)).repartition("k", "b")
    w = Window.partitionBy("k", "b", "p").orderBy(F.col("ver").desc_nulls_last(), F.col("v").desc_nulls_last())
    return x.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("k", "b", "p", "v")


def held_runs(
    df: DataFrame,
    *,
    key: Column,
    position: Column,
    label: Column,
    version: Column | None = None,
    max_slip: int = 2,
    min_length: int = 1,
    rate: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Held stretches (key string, label, first long, last long, length long, events long[, seconds double]).

    ``length`` is last - first + 1, ``events`` the positions in the stretch that do carry the
    label, ``seconds`` length / rate. Null labels start no stretch; repeated rows and older
    versions count once; an empty table gives an empty result; other columns are ignored,
    whatever their names. ``min_length`` drops shorter stretches, whole ones only.
    """
    if block <= max_slip + 1:
        raise ValueError("a block must be longer than a slip")
    near = max_slip + 1
    x = latest_labels(df, key, position, label, version, block).where("v is not null")
    w = Window.partitionBy("k", "b", "v").orderBy("p")
    x = x.select("k", "b", "v", "p", F.lag("p").over(w).alias("before"), F.lead("p").over(w).alias("after"), F.row_number().over(w).alias("rn"))
    x = x.withColumn("opens", F.coalesce(F.col("p") - F.col("before") > near, F.lit(True)))
    x = x.withColumn("closes", F.coalesce(F.col("after") - F.col("p") > near, F.lit(True)))
    x = x.where("opens or closes")
    x = x.select(
        "k", "b", "v", "opens",
        F.col("p").alias("first"),
        F.when(F.col("closes"), F.col("p")).otherwise(F.lead("p").over(w)).alias("last"),
        (F.when(F.col("closes"), F.col("rn")).otherwise(F.lead("rn").over(w)) - F.col("rn") + 1).cast("long").alias("events"),
    ).where("opens")
    low, high = F.col("b") * block, (F.col("b") + 1) * block
    edge = (F.col("first") < low + near) | (F.col("last") >= high - near)
    x = x.withColumn("edge", edge).where(F.col("edge") | (F.col("last") - F.col("first") + 1 >= min_length))
    alone = F.when(~F.col("edge"), F.col("first"))
    x = x.withColumn("part", alone)
    s = Window.partitionBy("k", "v", "part").orderBy("first")
    x = x.withColumn("new", F.coalesce(F.col("first") - F.lag("last").over(s) > near, F.lit(True)).cast("int"))
    x = x.withColumn("run", F.sum("new").over(s.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy("k", "v", "part", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))
    out = x.select(
        F.col("k").alias("key"), F.col("v").alias("label"), "first", "last",
        (F.col("last") - F.col("first") + 1).alias("length"), "events",
    ).where(F.col("length") >= min_length)
    return out if rate is None else out.withColumn("seconds", F.col("length") / F.lit(float(rate)))
