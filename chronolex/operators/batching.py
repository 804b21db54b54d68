"""Greedy size bins, fixed buckets and the duration-bucketed distributed sampler."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from chronolex.operators.ranking import global_rank


def greedy_bins(df: DataFrame, key: str, size: str, bins: int | None = None, threshold: float | None = None, group: list[str] | None = None, keep_last: bool = True) -> DataFrame:
    """(group..., bin, key, size): items in order of key; a bin closes with the item that reaches the threshold.

    The threshold is given or the group's total over ``bins``. A fold over the sorted items runs
    through a group in one task, a batch of rows at a time, and carries on only the open bin; the
    sort spills. The last, unfilled bin is kept unless ``keep_last`` is False.
    """
    keys = group or []
    x = df.select(*keys, F.col(key), F.col(size).cast("double").alias(size))
    if threshold is not None:
        x = x.withColumn("__limit", F.lit(float(threshold)))
    else:
        totals = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg((F.sum(F.col(size).cast("double")) / bins).alias("__limit"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        x = x.join(totals, same).select(*x.columns, "__limit")
    x = (x.repartition(*keys) if keys else x.repartition(1)).sortWithinPartitions(*keys, key, size)
    fields = [*x.drop("__limit").schema.fields, StructField("bin", LongType()), StructField("__full", BooleanType())]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, acc, n = None, 0.0, 0
        for batch in batches:
            groups = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else itertools.repeat(())
            out, closed = [], []
            for g, s, limit in zip(groups, batch.column(size).to_pylist(), batch.column("__limit").to_pylist()):
                if g != at:
                    at, acc, n = g, 0.0, 0
                acc = None if acc is None or s is None else acc + s
                full = acc is not None and limit is not None and acc >= limit
                out.append(n)
                closed.append(full)
                if full:
                    acc, n = 0.0, n + 1
            kept = [c for c in batch.schema.names if c != "__limit"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int64()), pa.array(closed, pa.bool_())], names=[*kept, "bin", "__full"])

    x = x.mapInArrow(fold, StructType(fields))
    if not keep_last:
        x = x.withColumn("__open", F.count_if("__full").over(Window.partitionBy(*(keys or [F.lit(1)])))).where(F.col("bin") < F.col("__open"))
    return x.select(*keys, "bin", key, size)


def flush_chunks(df: DataFrame, key: str, frames: str, buffer: int, group: list[str] | None = None) -> DataFrame:
    """Which output file each item goes to when a buffer is flushed once it holds ``buffer`` frames."""
    return greedy_bins(df, key, frames, threshold=buffer, group=group).withColumnRenamed("bin", "file")


def fixed_buckets(df: DataFrame, key: str, buckets: int = 100) -> DataFrame:
    """(key, bucket): distinct keys in order, as many a bucket as fit ``buckets``, at least one."""
    x = global_rank(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], "__rank")
    limit = max(1, x.count() // buckets)
    return x.select(key, F.floor(F.col("__rank") / limit).alias("bucket"))


def bucketed_sampler(df: DataFrame, *, folder: str, item: str, duration: str, position: str, batch: int, replicas: int, scale: int, seed: int | None = None, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """(pos, folder, item, duration, rank, turn): the order in which replicas see the items.

    Folders come in order of first appearance; inside one, chunks of batch x replicas x scale are
    sorted by duration. The total is padded to a multiple of the replicas by the first folder's
    own first items, or cut with ``drop_last``. Replica ``rank`` sees positions rank, rank +
    replicas, ... With ``seed`` the order inside folders and batches is a hash of seed and epoch.
    """
    effective = batch * replicas
    chunk = effective * scale
    n = df.count()
    per = math.ceil((n - replicas) / replicas) if drop_last and n % replicas else math.ceil(n / replicas)
    total = per * replicas
    pad = max(0, total - n)
    x = df.select(F.col(folder).alias("folder"), F.col(item).alias("item"), F.col(duration).alias("duration"), F.col(position).alias("position"))
    first = x.groupBy("folder").agg(F.min("position").alias("seen"))
    order = F.col("position") if seed is None else F.xxhash64(F.lit(seed), F.lit(epoch), "item")
    x = global_rank(x.join(first, "folder").withColumn("o", order), ["seen", "o", "position"], "at")
    folders = x.groupBy("seen").agg(F.min("at").alias("base"), F.count("*").alias("size"))
    x = x.drop("o").join(folders, "seen").withColumn("o", F.col("at") - F.col("base")).withColumn("copy", F.lit(0))
    if pad:
        head = x.where("base = 0")
        size = head.count()
        extra = head.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(math.ceil(pad / size)))))
        extra = extra.withColumn("o", F.col("o") + F.col("copy") * size).where(F.col("o") < size + pad)
        x = x.withColumn("base", F.when(F.col("base") > 0, F.col("base") + pad).otherwise(0)).unionByName(extra)
    x = x.withColumn("block", F.floor(F.col("o") / chunk))
    w = Window.partitionBy("seen", "block").orderBy("duration", "o")
    x = x.withColumn("q", F.row_number().over(w) - 1)
    if seed is not None:
        within = Window.partitionBy("seen", "block", F.floor(F.col("q") / effective)).orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), "item", "copy"), "o")
        x = x.withColumn("q", F.floor(F.col("q") / effective) * effective + F.row_number().over(within) - 1)
    x = x.withColumn("pos", F.col("base") + F.col("block") * chunk + F.col("q"))
    x = x.where(F.col("pos") < total)
    return x.select("pos", "folder", "item", "duration", F.pmod("pos", F.lit(replicas)).alias("rank"), F.floor(F.col("pos") / replicas).alias("turn"))


def validation_split(df: DataFrame, bucket: str, fraction: float, at_most_one: bool = False) -> DataFrame:
    """``df`` with side: the first buckets to val, the rest to train; at least one to val.

    ``at_most_one`` sends at most one bucket to val, and none if the fraction yields none.
    """
    n = df.agg(F.max(bucket)).first()[0]
    n = 0 if n is None else int(n) + 1
    first = min(1, int(n * fraction)) if at_most_one else max(1, int(n * fraction))
    return df.withColumn("side", F.when(F.col(bucket) < first, "val").otherwise("train"))


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``df`` with side by a hash of the key, in the given shares."""
    point = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / (1 << 30)
    upto, side = 0.0, F.lit(None).cast("string")
    cuts = []
    for name, share in shares.items():
        upto += share / sum(shares.values())
        cuts.append((name, upto))
    side = F.lit(cuts[-1][0])
    for name, cut in reversed(cuts[:-1]):
        side = F.when(point < cut, name).otherwise(side)
    return df.withColumn("side", side)


def permuted(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a random order that depends on seed and key only."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
