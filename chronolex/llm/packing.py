"""Items into containers of fixed capacity: problem 8.

Linear grouping (de la Vega and Lueker): the large items are cut, by size, into groups of about
equal cardinality and rounded up to the largest size of their group. For so few sizes the best
configurations of a container come from a linear programme with column generation. The actual
items then take the places of their group by rank, and the small ones are put best-fit into the
space left.

Only the histogram of sizes reaches the driver, one row a size and so at most ``capacity`` rows
however many the items; it returns a plan of at most groups x configurations rows. Ranks are
computed in buckets, and the small items are fitted in shards of bounded size, so no step holds a
group of unbounded size in one task.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.ranks import running
from chronolex.shared import materialise

GROUPS = 48
SMALL = 1 / 4
SHARD_ROWS = 20_000
BUCKET_ROWS = 100_000


def group_sizes(histogram: dict[int, int], groups: int) -> list[tuple[int, int, int]]:
    """(smallest, largest, count) of groups of about equal cardinality, largest sizes first.

    A size frequent enough for a group of its own is not rounded up with larger ones.
    """
    fair = sum(histogram.values()) / groups
    out: list[tuple[int, int, int]] = []
    members: list[int] = []

    def close() -> None:
        if members:
            out.append((members[-1], members[0], sum(histogram[m] for m in members)))
            members.clear()

    for size in sorted(histogram, reverse=True):
        if histogram[size] >= fair:
            close()
        members.append(size)
        if sum(histogram[m] for m in members) >= fair:
            close()
    close()
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worthy multiset of sizes within the capacity (knapsack by number of items)."""
    most = capacity // int(sizes.min())
    value = np.zeros(capacity + 1)
    taken = []
    for _ in range(most):
        choice = np.full(capacity + 1, -1)
        best = value.copy()
        for i, s in enumerate(sizes):
            gain = np.full(capacity + 1, -1.0)
            gain[s:] = value[: capacity + 1 - s] + worth[i]
            better = gain > best + 1e-12
            best[better], choice[better] = gain[better], i
        taken.append(choice)
        if (choice < 0).all():
            break
        value = best
    room, out = capacity, np.zeros(len(sizes), int)
    for choice in reversed(taken):
        i = choice[room]
        if i >= 0:
            out[i] += 1
            room -= int(sizes[i])
    return float(out @ worth), out


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """(items of each size, number of containers) holding all ``counts`` items.

    The linear programme of least containers is solved by generated columns; its solution is
    rounded down, and first-fit configurations take the few items of each size that are left.
    """
    if not sizes:
        return []
    s, n = np.array(sizes), np.array(counts, float)
    basis = np.diag(capacity // s).astype(float)
    x = n / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth = np.maximum(inverse.sum(0), 0)
        gain, config = best_configuration(s, worth, capacity)
        if gain <= 1 + 1e-7:
            break
        x = inverse @ n
        direction = inverse @ config
        ok = direction > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = config
    x = np.maximum(np.linalg.inv(basis) @ n, 0)
    plan: Counter[tuple[int, ...]] = Counter()
    left = n.astype(int)
    for j in range(len(s)):
        config, times = basis[:, j].round().astype(int), int(math.floor(x[j] + 1e-9))
        used = config > 0
        if times and used.any():
            times = min(times, int((left[used] // config[used]).min()))
            if times > 0:
                plan[tuple(config.tolist())] += times
                left = left - config * times
    order = np.argsort(-s)
    while left.any():
        config, room = np.zeros(len(s), int), capacity
        for i in order:
            k = min(int(left[i]), room // int(s[i]))
            config[i] += k
            room -= k * int(s[i])
        used = config > 0
        times = int((left[used] // config[used]).min())
        plan[tuple(config.tolist())] += times
        left = left - config * times
    return sorted(plan.items(), reverse=True)


def places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (group, first rank, end rank, first container, items a container), and the containers."""
    rows, base, rank = [], 0, Counter()
    for config, times in plan:
        for g, k in enumerate(config):
            if k:
                rows.append((g, rank[g], rank[g] + k * times, base, k))
                rank[g] += k * times
        base += times
    return rows, base


def best_fit(rooms: list[tuple[int, int]], items: list[int], capacity: int, fresh: int) -> list[int]:
    """A container for each item, largest first, where it leaves the least room.

    ``rooms``: (room, container). New containers are numbered fresh, fresh - 1, ...
    """
    free = sorted(rooms)
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i], i)):
        at = bisect.bisect_left(free, (items[i], -(1 << 62)))
        if at < len(free):
            room, container = free.pop(at)
        else:
            room, container = capacity, fresh
            fresh -= 1
        out[i] = container
        if room > items[i]:
            bisect.insort(free, (room - items[i], container))
    return out


def pack(df: DataFrame, *, key: Column, size: Column, capacity: int, groups: int = GROUPS, small: float = SMALL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, piece long, size long, container long): every item in a container of ``capacity``.

    An item larger than the capacity is split: its pieces 0, 1, ... have the full capacity, each a
    container of its own, but for the last, which is packed like any other item. No other item is
    split. Items of a null or non-positive size take no room: one piece of size 0 and a null
    container. Rows are items: repeated rows are packed as often as they occur; a null key is a
    key. An empty table gives an empty result; other columns are ignored, whatever their names.
    Container numbers are unique, not consecutive.
    """
    kind = df.select(key.alias("key")).schema["key"].dataType.simpleString()
    x = df.select(key.alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("n"))
    x = x.select("key", F.greatest("n", F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("item"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("long"))
    x = x.select("item", "key", "n", F.explode(pieces).alias("piece"))
    x = materialise(x.select("item", "key", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity).cast("long")).alias("size")), "items")
    spark = x.sparkSession

    histogram = {r["size"]: r["n"] for r in x.groupBy("size").agg(F.count("*").alias("n")).collect()}
    nothing, full = histogram.pop(0, 0), histogram.pop(capacity, 0)
    least = capacity * small
    large = {s: n for s, n in histogram.items() if s > least}
    grouped = group_sizes(large, groups) if large else []
    plan, used = places(configurations([top for _, top, _ in grouped], [n for *_, n in grouped], capacity))

    group = F.lit(None).cast("int")
    for g, (low, top, _) in enumerate(grouped):
        group = F.when(F.col("size").between(low, top), F.lit(g)).otherwise(group)
    group = F.when(F.col("size") == capacity, F.lit(-1)).otherwise(group)
    big = x.withColumn("g", group).where("g is not null")
    spread = max(1, math.ceil((full + sum(large.values())) / BUCKET_ROWS))
    big = big.withColumn("b", F.pmod(F.xxhash64("item", "piece"), F.lit(spread)))
    big = running(big, ["g"], "b", ["size", "item", "piece"], name="rank")
    rows = spark.createDataFrame([*plan, (-1, 0, full, used, 1)], "g int, low long, high long, base long, k long")
    at = big.join(F.broadcast(rows.withColumnRenamed("g", "pg")), (F.col("g") == F.col("pg")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = at.select("key", "piece", "size", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("k"))).alias("container"))
    at = materialise(at, "placed")

    none = x.where("size = 0").select("key", "piece", "size", F.lit(None).cast("long").alias("container"))
    little = x.where((F.col("size") > 0) & (F.col("size") <= least))
    rest = sum(n for s, n in histogram.items() if s <= least)
    out = at.unionByName(none) if nothing else at
    if not rest:
        return out
    shards = max(1, math.ceil((rest + used) / shard_rows))
    rooms = at.where(F.col("size") < capacity).groupBy("container").agg((F.lit(capacity) - F.sum("size")).alias("size")).where("size > 0")
    rooms = rooms.select(F.pmod(F.xxhash64("container"), F.lit(shards)).alias("shard"), F.lit(None).cast(kind).alias("key"), F.lit(None).cast("long").alias("piece"), "size", "container")
    little = little.select(F.pmod(F.xxhash64("item", "piece", F.lit(1)), F.lit(shards)).alias("shard"), "key", "piece", "size", F.lit(None).cast("long").alias("container"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        is_room = pdf["piece"].isna()
        room, item = pdf[is_room], pdf[~is_room].sort_values(["size", "key", "piece"])
        fresh = -1 - (int(pdf["shard"].iloc[0]) << 32)
        free = list(zip(room["size"].astype(int), room["container"].astype(int)))
        got = best_fit(free, item["size"].astype(int).tolist(), capacity, fresh)
        return pd.DataFrame({"key": item["key"], "piece": item["piece"].astype("int64"), "size": item["size"], "container": np.array(got, np.int64)})

    fitted = little.unionByName(rooms).groupBy("shard").applyInPandas(fit, f"key {kind}, piece long, size long, container long")
    return out.unionByName(fitted)
