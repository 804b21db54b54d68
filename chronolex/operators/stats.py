"""Statistics of segments: empirical percentiles, thresholds, weighted and nested means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators.ranking import global_rank


def finite(c: Column) -> Column:
    """The value, null where it is NaN."""
    return F.when(~F.isnan(c), c)


def hours(seconds: Column) -> Column:
    """Sum in hours, 0 for no rows."""
    return F.coalesce(F.sum(finite(seconds)), F.lit(0.0)) / 3600


def empirical_percentile(df: DataFrame, value: str, order: list[str], out: str = "pct") -> DataFrame:
    """``df`` with rank / n, ranks from 0 in order of ``value`` and then ``order``; nulls and NaN are left out."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    x = global_rank(x, [value, *order], "__rank")
    n = x.count()
    return x.withColumn(out, F.col("__rank") / F.lit(max(1, n))).drop("__rank")


def percentile_bands(df: DataFrame, pct: str, point: float, width: float) -> DataFrame:
    """``df`` with band: accepted (point - width, point], rejected (point, point + width], in percent."""
    p = F.col(pct) * 100
    band = F.when((p > point - width) & (p <= point), "accepted").when((p > point) & (p <= point + width), "rejected")
    return df.withColumn("band", band).where("band is not null")


def percentile_threshold(df: DataFrame, pct: str, value: str, point: float, tolerance: float = 0.001) -> DataFrame:
    """Mean of the value over the rows within ``tolerance`` of the percentile."""
    return df.where(F.abs(F.col(pct) - point / 100) < tolerance).agg(F.avg(value).alias("threshold"))


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean over ``inner`` in each ``outer`` group, then the mean of those; not the global mean."""
    x = df.groupBy(outer, inner).agg(F.avg(value).alias("m"))
    x = x.groupBy(outer).agg(F.avg("m").alias("m"))
    return x.agg(F.avg("m").alias("mean_of_means"))


def describe(value: Column, prefix: str) -> list[Column]:
    """avg, std, median and the 60th to 90th percentiles of a measure, NaN left out."""
    v = finite(value)
    return [F.avg(v).alias(f"avg_{prefix}"), F.stddev_samp(v).alias(f"std_{prefix}"), F.median(v).alias(f"median_{prefix}"), *(F.percentile(v, p / 100).alias(f"{prefix}_{p}") for p in (60, 70, 75, 80, 90))]


def minutes_seconds(seconds: Column) -> Column:
    """m:s without padding, the seconds rounded down."""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.pmod(whole, F.lit(60)).cast("string"))
