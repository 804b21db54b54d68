"""Timelines of recordings: runs of consecutive segments, fallback grids, merged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING, FALLBACK, ORIGINAL = 0, 1, 2


def islands(df: DataFrame, key: str, index: str, drop_last: bool = False) -> DataFrame:
    """(key, start, end, cnt): runs of consecutive indexes; repeated ones count once.

    ``drop_last`` leaves out the last run of every key.
    """
    x = df.select(key, F.col(index).cast("long").alias("i")).where("i is not null").distinct()
    x = x.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    x = x.groupBy(key, "run").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("cnt")).drop("run")
    if drop_last:
        x = x.withColumn("__last", F.max("start").over(Window.partitionBy(key))).where("start < __last").drop("__last")
    return x


def fallback_stretches(source: DataFrame, fallback: DataFrame, key: str, index: str, duration: str, default: float = 5.0) -> DataFrame:
    """(key, idx, cnt, origin, each, duration): the fallback grid with one row an empty stretch.

    A missing stretch of ``cnt`` indexes from ``idx`` on lasts ``each`` = ``default`` times ``cnt``; every
    other row is one index. The rows are linear in those of the tables, however long the stretches are.
    """
    s = source.select(key, F.col(index).cast("long").alias("idx"), F.col(duration).alias("s")).where("idx is not null")
    f = fallback.select(key, F.col(index).cast("long").alias("idx"), F.col(duration).alias("f")).where("idx is not null").join(s.select(key).distinct(), key, "left_semi")
    both = s.join(f, [key, "idx"], "full").withColumn("__s", F.col("s").isNotNull()).withColumn("__f", F.col("f").isNotNull()).where("idx >= 0")
    after = F.lag("idx", 1, -1).over(Window.partitionBy(key).orderBy("idx")) + 1
    origin = F.when(F.col("__f"), FALLBACK).when(F.col("__s"), ORIGINAL).otherwise(MISSING)
    each = F.when(F.col("__f"), F.col("f")).when(F.col("__s"), F.col("s")).otherwise(F.lit(default))
    row = F.struct(F.col("idx"), F.lit(1).cast("long").alias("cnt"), origin.alias("origin"), each.alias("each"))
    gap = F.struct(F.col("after").alias("idx"), (F.col("idx") - F.col("after")).alias("cnt"), F.lit(MISSING).alias("origin"), F.lit(default).alias("each"))
    x = both.withColumn("after", after).select(key, F.explode(F.when(F.col("idx") > F.col("after"), F.array(gap, row)).otherwise(F.array(row))).alias("r"))
    return x.select(key, "r.idx", "r.cnt", "r.origin", "r.each", (F.col("r.each") * F.col("r.cnt")).alias("duration"))


def unfold(df: DataFrame, key: str, chunk: int = 4096) -> DataFrame:
    """Stretches (key, idx, cnt, each, start where there is one) as one row an index, of cnt 1.

    A long stretch is cut into chunks that are spread over the tasks before they are unfolded.
    """
    x = df.withColumn("__a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1, F.lit(chunk).cast("long")))).repartition(key, "idx", "__a")
    x = x.withColumn("__n", F.explode(F.sequence(F.col("__a"), F.least(F.col("__a") + chunk, F.col("cnt")) - 1)))
    x = x.withColumn("idx", F.col("idx") + F.col("__n")).withColumn("cnt", F.lit(1).cast("long")).withColumn("duration", F.col("each"))
    if "start" in df.columns:
        x = x.withColumn("start", F.col("start") + F.col("each") * F.col("__n")).withColumn("end", F.col("start") + F.col("each"))
    return x.drop("__a", "__n")


def fallback_grid(source: DataFrame, fallback: DataFrame, key: str, index: str, duration: str, default: float = 5.0) -> DataFrame:
    """(key, idx, origin, duration): every index from 0 to the last, the fallback before the source.

    Both tables hold one row a key and index. Keys of the source alone decide which recordings
    come out; an index of neither table is missing and lasts ``default``.
    """
    return unfold(fallback_stretches(source, fallback, key, index, duration, default), key).select(key, "idx", "origin", "duration")


def running_clock(df: DataFrame, key: str, order: str, duration: str = "duration") -> DataFrame:
    """``df`` with start and end: durations laid end to end in order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("end", F.sum(duration).over(w))
    return x.withColumn("start", F.col("end") - F.col(duration))


def merge_runs(df: DataFrame, key: str, order: str, origin: str = "origin", least: float = 0.0) -> DataFrame:
    """(key, run, cnt, start, end, origin): neighbours of one origin merged.

    Input rows have cnt, start and end. A run shorter than ``least`` becomes missing (origin 0),
    but stays a row of its own.
    """
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumn("__new", F.coalesce((F.col(origin) != F.lag(origin).over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(key, "run").agg(F.sum("cnt").alias("cnt"), F.min("start").alias("start"), F.max("end").alias("end"), F.first(origin).alias("origin"))
    return x.withColumn("origin", F.when(F.col("end") - F.col("start") >= least, F.col("origin")).otherwise(MISSING))


def two_stage_merge(df: DataFrame, key: str, order: str, least: float) -> DataFrame:
    """Runs of origins, then runs of used (1) and missing (0), the short ones missing."""
    x = merge_runs(df, key, order)
    x = x.withColumn("origin", (F.col("origin") != MISSING).cast("int"))
    return merge_runs(x.withColumnRenamed("run", "__order"), key, "__order", least=least)


def origin_durations(df: DataFrame, key: str) -> DataFrame:
    """(key, missing, fallback, original): seconds by origin."""
    length = F.col("end") - F.col("start")
    names = {"missing": MISSING, "fallback": FALLBACK, "original": ORIGINAL}
    return df.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("origin") == o, length)), F.lit(0.0)).alias(n) for n, o in names.items()))


def recover_map(source: DataFrame, fallback: DataFrame, key: str, index: str) -> DataFrame:
    """(key, line): which table has each index between the first and the last.

    ``3`` the source, ``[3]`` the fallback, ``@`` neither, parted by ``--``; an index of both
    tables is written twice.
    """
    s = source.select(key, F.col(index).alias("i"), F.lit(1).alias("s")).distinct()
    f = fallback.select(key, F.col(index).alias("i"), F.lit(1).alias("f")).distinct()
    both = s.join(f, [key, "i"], "full")
    empty = F.col("i") - F.lag("i").over(Window.partitionBy(key).orderBy("i")) - 1
    number: Column = F.col("i").cast("string")
    word = F.concat_ws("--", F.when(F.col("s") == 1, number), F.when(F.col("f") == 1, F.concat(F.lit("["), number, F.lit("]"))))
    x = both.select(key, "i", F.concat(F.repeat(F.lit("@--"), F.coalesce(empty, F.lit(0)).cast("int")), word).alias("w"))
    x = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("w"))
    return x.select(key, F.array_join(F.transform("w", lambda r: r["w"]), "--").alias("line"))
