"""Joins and set operations: lookups, agreement joins, split recovery, range joins, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have at most ``limit`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup(df: DataFrame, pairs: DataFrame, key: str, value: str, out: str, keep_missing: bool = False) -> DataFrame:
    """``out``: the value paired with ``key``; missing keys give null, or the key itself."""
    found = pairs.select(F.col(key).alias("__k"), F.col(value).alias("__v")).dropDuplicates(["__k"])
    x = df.join(found, F.col(key) == F.col("__k"), "left")
    got = F.coalesce("__v", F.col(key)) if keep_missing else F.col("__v")
    return x.withColumn(out, got).drop("__k", "__v")


def join_found(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join whose unmatched rows are dropped, that is an inner join."""
    return left.join(right, on)


def agreement_join(left: DataFrame, right: DataFrame, on: list[str], text: str = "form", separator: str = " ") -> DataFrame:
    """Rows agreeing in ``on``, texts joined, distinct; the other tag columns come from the right."""
    l = left.select(*on, F.col(text).alias("__left"))
    return l.join(right, on).select(*[c for c in right.columns if c != text], F.concat("__left", F.lit(separator), F.col(text)).alias(text)).distinct()


def agreement_chain(tables: list[DataFrame], on: list[str], text: str = "form") -> DataFrame:
    """Agreement joins folded over the words of a phrase, from left to right."""
    return reduce(lambda a, b: agreement_join(a, b, on, text), tables)


def recover_split(source: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(source and the rows of ``other`` sharing a key with it, the rest of ``other``)."""
    keys = source.select(key).where(F.col(key).isNotNull()).distinct()
    return source.unionByName(other.join(keys, key, "left_semi"), allowMissingColumns=True), other.join(keys, key, "left_anti")


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], position: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """Points inside the closed ranges of the same keys.

    With ``width`` both sides also meet on the bins of that size a range covers, which splits keys
    holding many points; a range must then cover few bins.
    """
    if width is None:
        return points.join(ranges, on).where(F.col(position).between(F.col(start), F.col(end)))
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    r = ranges.where(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(bins))
    p = points.withColumn("__bin", F.floor(F.col(position) / width))
    return p.join(r, [*on, "__bin"]).where(F.col(position).between(F.col(start), F.col(end))).drop("__bin")


def interval_join(points: DataFrame, ranges: DataFrame, on: list[str], position: str, start: str, end: str, least: float = 1.0) -> DataFrame:
    """Points inside the closed ranges of the same keys, on bins whose width suits each range.

    A range is laid on bins of the power of two that is next above its length (never below
    ``least``), so it covers two of them at most; a point meets one bin of every width that occurs
    among the ranges of its keys. Widths are powers of two, so few occur however the lengths differ. The
    join is on (keys, width, bin). Ranges that end before they start, null and NaN bounds or positions match
    nothing.
    """
    length = F.greatest((F.col(end) - F.col(start)).cast("double"), F.lit(float(least)))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(length)))
    sane = ~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(end).cast("double"))
    r = ranges.where((F.col(start) <= F.col(end)) & sane).withColumn("__w", width)
    r = r.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("__w")), F.floor(F.col(end) / F.col("__w")))))
    widths = r.select(*on, "__w").distinct()
    p = points.where(F.col(position).isNotNull() & ~F.isnan(F.col(position).cast("double"))).join(widths, on)
    p = p.withColumn("__bin", F.floor(F.col(position) / F.col("__w")))
    return p.join(r, [*on, "__w", "__bin"]).where(F.col(position).between(F.col(start), F.col(end))).drop("__w", "__bin")


def theta_join(left: DataFrame, right: DataFrame, on: list[str], condition: Column, hint: str = "shuffle_hash") -> DataFrame:
    """Rows agreeing in ``on`` for which ``condition`` holds too.

    The join is on the keys by the physical way ``hint`` names (merge, shuffle_hash), the condition is a
    filter inside it: no product of the tables, only of what shares a key. ``on`` may not be empty.
    """
    if not on:
        raise ValueError("a theta join without an equal key would be a product of the tables")
    same = F.lit(True)
    for k in on:
        same = same & (left[k] == right[k])
    return left.join(right.hint(hint), same & condition).drop(*(right[k] for k in on))


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the latest right row not after it (union and last-known)."""
    l = left.select(*left.columns, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r = right.select(*(F.col(c) if c in on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    x = l.unionByName(r).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return x.where("__side = 1").drop("__t", "__side", "__v")


def keys_differ(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(only_left, only_right, both): distinct keys of two tables compared."""
    l = left.select(*on).distinct().withColumn("__l", F.lit(1))
    r = right.select(*on).distinct().withColumn("__r", F.lit(1))
    x = l.join(r, on, "full")
    return x.agg(F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"), F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("both"))


def variant_product(*variants: Column) -> Column:
    """All concatenations of one string from each array, in order of the arrays."""
    def two(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit(" "), y))))

    return reduce(two, variants)


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
