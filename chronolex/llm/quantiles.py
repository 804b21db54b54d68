"""Percentiles per group with bounded rank error, mergeable across partitions and days: problem 2.

A summary of n values is a sorted list of tuples (value, rmin, rmax): at least rmin of the n are
at most the value, and the value's lowest rank is at most rmax. Asked for rank r, a tuple answers
with an error of at most max(r - rmin, rmax - r, 0) ranks. Every partition of the input makes its
summaries before any shuffle, compressing by the permitted uncertainty; summaries are then merged
level by level, a bounded number at a time, and each states the rank error it has accumulated.
All steps are deterministic: the same partitions give the same summaries.

A merge adds up, for each value, the bounds the parts have for it; a part without the value gives
the rmin of its last tuple below and the rmax of its first tuple above, less one. That adds no
error relative to the number of values. Compressing lets neighbouring tuples be ``gap`` ranks
apart, an error of gap / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.shared import materialise

#: (values, rmin, rmax, n)
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]

FIELDS = "n long, value array<double>, rmin array<long>, rmax array<long>, error long"
FAN_IN = 16
BUFFER = 1 << 18


def summarise(values: np.ndarray) -> Summary:
    """Exact summary of some values; equal values share one tuple."""
    values, counts = np.unique(values, return_counts=True)
    upto = np.cumsum(counts)
    return values, upto, upto - counts + 1, int(upto[-1]) if len(upto) else 0


def merge(parts: list[Summary]) -> Summary:
    """Summary of all values of the parts together."""
    values = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.empty(0)
    rmin, below, n = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), 0
    for v, low, high, count in parts:
        left, right = np.searchsorted(v, values, "left"), np.searchsorted(v, values, "right")
        rmin += np.append(0, low)[right]
        below += np.append(high - 1, count)[left]
        n += count
    return values, rmin, below + 1, n


def compress(s: Summary, gap: float) -> Summary:
    """Drop tuples as long as neighbours stay within ``gap`` ranks; the extremes stay."""
    v, rmin, rmax, n = s
    if len(v) <= 2 or gap <= 1:
        return s
    keep = [0]
    while keep[-1] < len(v) - 1:
        far = int(np.searchsorted(rmax, rmin[keep[-1]] + gap, "right")) - 1
        keep.append(min(max(far, keep[-1] + 1), len(v) - 1))
    return v[keep], rmin[keep], rmax[keep], n


def rank_error(s: Summary) -> int:
    """The largest error of an answer, over all ranks."""
    return max(0, int(np.max(s[2][1:] - s[1][:-1], initial=0)) // 2)


def quantile(s: Summary, share: float) -> tuple[float | None, int | None]:
    """Value at rank ceil(share * n) and the bound of its rank error; nulls for no values."""
    v, rmin, rmax, n = s
    if not n:
        return None, None
    rank = min(max(1, int(np.ceil(share * n - 1e-9))), n)
    off = np.maximum(np.maximum(rank - rmin, rmax - rank), 0)
    i = int(np.argmin(off))
    return float(v[i]), int(off[i])


def _row(s: Summary) -> tuple:
    return s[3], s[0].tolist(), s[1].tolist(), s[2].tolist(), rank_error(s)


def _of(row) -> Summary:
    return np.asarray(row["value"], float), np.asarray(row["rmin"], np.int64), np.asarray(row["rmax"], np.int64), int(row["n"])


def partition_summaries(df: DataFrame, group: list[Column], value: Column, eps: float = 0.01, buffer: int = BUFFER) -> DataFrame:
    """(g array<string>, part int, n, value, rmin, rmax, error): one summary a group and partition.

    Values that are null, NaN or infinite are no values; a null group key is a key of its own.
    No shuffle: a partition buffers at most ``buffer`` values.
    """
    x = df.select(F.array(*(c.cast("string") for c in group)).alias("g"), value.cast("double").alias("x"))
    x = x.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    x = x.select(F.to_json("g").alias("g"), "x", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[str, list[Summary]] = {}
        held: list[pd.DataFrame] = []
        size, part = 0, 0

        def flush() -> None:
            both = pd.concat(held, ignore_index=True)
            codes, keys = pd.factorize(both["g"])
            order = np.lexsort((both["x"], codes))
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for key, xs in zip(keys, np.split(both["x"].to_numpy()[order], cuts)):
                s = summarise(xs)
                mine = done.setdefault(key, [])
                mine.append(compress(s, 0.5 * eps * s[3]))
                if len(mine) >= FAN_IN:
                    s = merge(mine)
                    done[key] = [compress(s, 0.75 * eps * s[3])]
            held.clear()

        for pdf in batches:
            if len(pdf):
                part = int(pdf["part"].iloc[0])
                held.append(pdf[["g", "x"]])
                size += len(pdf)
                if size >= buffer:
                    flush()
                    size = 0
        if held:
            flush()
        rows = []
        for key in sorted(done):
            s = merge(done[key])
            rows.append((key, part, *_row(compress(s, eps * s[3]))))
        yield pd.DataFrame(rows, columns=["g", "part", "n", "value", "rmin", "rmax", "error"])

    return x.mapInPandas(run, f"g string, part int, {FIELDS}")


def merge_summaries(parts: DataFrame, eps: float = 0.01, fan_in: int = FAN_IN, largest_part: int | None = None) -> DataFrame:
    """One summary a group, merged ``fan_in`` at a time: (g, n, value, rmin, rmax, error).

    ``parts`` holds summaries (g, part, ...) of partitions, or of other days of loading made by
    this very function with a ``part`` number added; each group holds at most one of a number.
    """
    if largest_part is None:
        parts = materialise(parts, "summaries")
        largest_part = parts.agg(F.max("part")).first()[0] or 0
    top = largest_part
    levels = max(1, int(np.ceil(np.log(max(2, top + 1)) / np.log(fan_in))))
    x = parts
    for level in range(1, levels + 1):
        gap = 2 * eps * (0.5 + 0.5 * level / levels)

        def join_up(pdf_iter: Iterator[pd.DataFrame], gap: float = gap) -> Iterator[pd.DataFrame]:
            for pdf in pdf_iter:
                rows = []
                for g, part, own in zip(pdf["g"], pdf["part"], pdf["s"]):
                    s = merge([_of(r) for r in own])
                    rows.append((g, part, *_row(compress(s, gap * s[3]) if len(own) > 1 else s)))
                yield pd.DataFrame(rows, columns=["g", "part", "n", "value", "rmin", "rmax", "error"])

        x = x.groupBy("g", F.floor(F.col("part") / fan_in).cast("int").alias("part"))
        x = x.agg(F.sort_array(F.collect_list(F.struct("n", "value", "rmin", "rmax"))).alias("s")).mapInPandas(join_up, f"g string, part int, {FIELDS}")
    return x.drop("part")


def percentiles(summaries: DataFrame, names: list[str], shares: list[float]) -> DataFrame:
    """(names..., n, percentiles array<struct<share, value, error>>) from merged summaries."""
    kind = "array<struct<share:double,value:double,error:long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [[dict(zip(("share", "value", "error"), (q, *quantile(_of(r), q)))) for q in shares] for r in pdf.to_dict("records")]
            yield pd.DataFrame({"g": pdf["g"], "n": pdf["n"], "percentiles": answers})

    x = summaries.mapInPandas(run, f"g string, n long, percentiles {kind}")
    g = F.from_json("g", "array<string>")
    return x.select(*(g[i].alias(c) for i, c in enumerate(names)), "n", "percentiles")


def grouped_percentiles(df: DataFrame, group: dict[str, Column], value: Column, shares: list[float], eps: float = 0.01) -> DataFrame:
    """Percentiles of ``value`` per group: (group names as string, n, percentiles).

    The rank of an answer is within eps * n of the rank asked for, and ``error`` states the bound
    that holds for it. Groups without any finite value give no row; repeated rows count as often
    as they occur (make them distinct first where they shall count once); an empty table gives an
    empty result; other columns play no part, whatever their names.
    """
    parts = partition_summaries(df, list(group.values()), value, eps)
    return percentiles(merge_summaries(parts, eps), list(group), shares)
