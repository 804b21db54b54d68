"""Groups of mutually similar label sequences by density peaks: problem 6.

Two records are similar when neither is more than ``max_ratio`` times as long as the other and
a longest common subsequence covers ``min_share`` of the shorter. No similar pair is lost:

* blocks: the records in order of length, ``part`` a block; two blocks meet unless every record
  of one is more than ``max_ratio`` times as long as all of the other;
* filter: the labels two records have in common, in whatever order, bound their subsequence from
  above; one matrix product bounds all pairs of two blocks. What is left is counted, then compared exactly;
* disk: the blocks are written once, packed, and read again by every task that needs them, so the
  disk grows with the records, not with the pairs of blocks;
* density: the number of similar records;
* peaks have no similar denser record; the others follow their pointers, by pointer doubling,
  to the peak that names their cluster.

The products grow with the square of the number of records, the exact comparisons with the
number of pairs that have their labels in common.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators.ranking import global_rank
from chronolex.shared import materialise, release

PART = 1024
#: Labels counted apart in the filter; what lies beyond shares their columns.
LABELS = 512
#: Rows of a matrix product at a time, so that it stays in the cache.
ROWS = 256
#: Blocks and bytes that a stretch of blocks may have.
HELD, HELD_BYTES = 64, 16 << 20


def label_sequences(df: DataFrame, *, key: Column, position: Column, label: Column, version: Column | None = None, min_held: int = 25, max_slip: int = 2) -> DataFrame:
    """(key, seq array<int>): the labels of a key in order, positions of held stretches left out.

    The latest version of a position holds; null labels and lost positions give no element.
    Keys whose labels all lie in held stretches have an empty sequence.
    """
    x = df.select(key.cast("string").alias("k"), position.cast("long").alias("p"), label.cast("int").alias("v"), (F.lit(0).cast("long") if version is None else F.unix_micros(version.cast("timestamp"))).alias("ver"))
    x = x.where("k is not null and p is not null").groupBy("k").agg(
        F.collect_list("p").alias("p"), F.collect_list(F.coalesce("v", F.lit(-1))).alias("v"), F.collect_list(F.coalesce("ver", F.lit(-(1 << 62)))).alias("ver")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["k"], "seq": [free_labels(np.asarray(p), np.asarray(v), np.asarray(t), min_held, max_slip) for p, v, t in zip(pdf["p"], pdf["v"], pdf["ver"])]})

    return x.mapInPandas(run, "key string, seq array<int>")


def free_labels(p: np.ndarray, v: np.ndarray, ver: np.ndarray, min_held: int, max_slip: int) -> np.ndarray:
    """Labels in order of position, without those in held stretches of ``min_held`` or more."""
    order = np.lexsort((v, ver, p))
    p, v = p[order], v[order]
    last = np.append(p[1:] != p[:-1], True)
    p, v = p[last], v[last]
    p, v = p[v >= 0], v[v >= 0]
    if not len(p):
        return v.astype(np.int32)
    by = np.lexsort((p, v))
    bp, bv = p[by], v[by]
    cut = np.flatnonzero((bv[1:] != bv[:-1]) | (bp[1:] - bp[:-1] > max_slip + 1)) + 1
    first, final = bp[np.insert(cut, 0, 0)], bp[np.append(cut, len(bp)) - 1]
    held = final - first + 1 >= min_held
    keep = np.ones(len(p), bool)
    for a, b in zip(first[held], final[held]):
        keep[np.searchsorted(p, a) : np.searchsorted(p, b, "right")] = False
    return v[keep].astype(np.int32)


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence, 64 and more cells a step (bit vectors in integers)."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = at.get(x)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def share_in_common(a: np.ndarray, b: np.ndarray, min_share: float, max_ratio: float) -> float:
    """Common subsequence over the shorter length; 0 where the pair cannot reach ``min_share``."""
    short, long = sorted((len(a), len(b)))
    if short == 0 or long > max_ratio * short:
        return 0.0
    top = 1 + max(int(a.max()), int(b.max()))
    if np.minimum(np.bincount(a, minlength=top), np.bincount(b, minlength=top)).sum() < min_share * short - 1e-6:
        return 0.0  # labels in common, in whatever order, bound the subsequence from above
    return common_length(a, b) / short


def length_blocks(seqs: DataFrame, part: int = PART) -> DataFrame:
    """(block, lo, hi, keys, data): ``part`` sequences that are next in length, none of them empty, and their shortest and longest."""
    x = global_rank(seqs.select("key", "seq", F.size("seq").cast("long").alias("size")).where("size > 0"), ["size", "key"], "rank")
    x = x.groupBy(F.floor(F.col("rank") / part).alias("block")).agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.collect_list(F.struct("key", "seq")).alias("s"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for seqs in pdf["s"]:
                labels = [np.asarray(r["seq"], np.int32) for r in seqs]
                data.append(zlib.compress(np.concatenate([np.array([len(labels)] + [len(v) for v in labels], np.int32), *labels]).tobytes(), 1))
            yield pdf[["block", "lo", "hi"]].assign(keys=[[r["key"] for r in seqs] for seqs in pdf["s"]], data=data)

    return x.mapInPandas(pack, "block long, lo long, hi long, keys array<string>, data binary")


def unpacked(data: bytes) -> list[np.ndarray]:
    """The sequences of a block."""
    x = np.frombuffer(zlib.decompress(data), np.int32)
    return np.split(x[1 + x[0] :], np.cumsum(x[1 : x[0]]))


def label_counts(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(labels, counts): how often each sequence has each label; beyond ``LABELS`` of them several share a column."""
    flat = np.concatenate(seqs) % LABELS
    used = np.bincount(flat, minlength=LABELS) > 0
    labels, column = np.flatnonzero(used), np.cumsum(used) - 1
    row = np.repeat(np.arange(len(seqs)) * len(labels), [len(v) for v in seqs])
    return labels, np.bincount(row + column[flat], minlength=len(seqs) * len(labels)).reshape(len(seqs), -1)


class Sketch:
    """What the filter needs of a block of sequences, none of them empty."""

    def __init__(self, seqs: list[np.ndarray]):
        self.seqs, self.sizes = seqs, np.array([len(s) for s in seqs])
        self.labels, counts = label_counts(seqs)
        self.counts, self.root = counts.astype(np.min_scalar_type(counts.max())), np.sqrt(counts).astype(np.float32)


def set_places(flags: np.ndarray) -> np.ndarray:
    """Flat positions of what is set, eight flags looked at a step: few are."""
    flat = flags.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


def candidates(x: list[np.ndarray] | Sketch, y: list[np.ndarray] | Sketch, min_share: float, max_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs that length and labels in common do not rule out.

    Of a label that one has ``a`` and the other ``b`` times, min(a, b) are in common, which is at
    most the root of a * b: one matrix product of the roots bounds all pairs, and the labels in
    common are counted for what is left.
    """
    x, y = (s if isinstance(s, Sketch) else Sketch(s) for s in (x, y))
    (u, v), (c, d) = (x.root, y.root), (x.counts, y.counts)
    if not np.array_equal(x.labels, y.labels):
        at = np.intersect1d(x.labels, y.labels, assume_unique=True, return_indices=True)[1:]
        u, v, c, d = u[:, at[0]], v[:, at[1]], c[:, at[0]], d[:, at[1]]
    short, long = ((s.sizes * (min_share * (1 - 1e-4))).astype(np.float32) for s in (x, y))  # less what rounding can take away
    ordered = short.max() <= long.min()
    found = []
    for a in range(0, len(u), ROWS):
        least = short[a : a + ROWS, None] if ordered else np.minimum.outer(short[a : a + ROWS], long)
        found.append(set_places(u[a : a + ROWS] @ v.T >= least) + a * len(v))
    i, j = np.divmod(np.concatenate(found), len(v))
    m, n = x.sizes[i], y.sizes[j]
    keep = np.maximum(m, n) <= max_ratio * np.minimum(m, n)
    i, j, least = i[keep], j[keep], min_share * np.minimum(m, n)[keep] - 1e-6
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 4096):
        part = slice(a, a + 4096)
        keep[part] = np.minimum(c.take(i[part], 0), d.take(j[part], 0)).sum(1, dtype=np.int64) >= least[part]
    return i[keep], j[keep]


def stretches(blocks: DataFrame) -> DataFrame:
    """(at, lo, hi, blocks array<struct>): blocks next in length, about as many a stretch as there are stretches."""
    n, most = blocks.agg(F.count("*"), F.max(F.length("data"))).first()
    size = max(1, min(math.ceil(math.sqrt(n)), HELD, HELD_BYTES // (most or 1)))
    x = blocks.groupBy(F.floor(F.col("block") / size).alias("at"))
    return x.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("block", "lo", "hi", "keys", "data")).alias("blocks"))


def similar_pairs(seqs: DataFrame, *, min_share: float = 0.65, max_ratio: float = 2.0, part: int = PART) -> DataFrame:
    """(a, b, share), a < b: all similar pairs of ``seqs`` (key, seq), each checked exactly.

    Stretches of blocks meet by a product of their files, which every task reads for itself: no
    block is shuffled, spilled or broadcast to meet another.
    """
    blocks = materialise(length_blocks(seqs, part), "blocks")
    held = materialise(stretches(blocks), "stretches", maxRecordsPerFile=1)
    release(blocks)
    i, j = (held.select(*(F.col(c).alias(f"{c}_{n}") for c in ("at", "lo", "hi", "blocks"))) for n in "ij")
    x = i.join(j.hint("shuffle_replicate_nl"), (F.col("at_i") <= F.col("at_j")) & (F.col("lo_j") <= F.col("hi_i") * max_ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Sketch] = {}

        def sketch(block: int, data: pa.Scalar) -> Sketch:
            if block not in known:
                if len(known) >= 2 * HELD:
                    known.clear()
                known[block] = Sketch(unpacked(data.as_py()))
            return known[block]

        for batch in batches:
            for left, right in zip(batch.column("blocks_i"), batch.column("blocks_j")):
                (i, hi, keys_i, data_i), (j, lo, keys_j, data_j) = ([s.values.field(f) for f in ("block", bound, "keys", "data")] for s, bound in ((left, "hi"), (right, "lo")))
                i, hi, j, lo = (v.to_numpy() for v in (i, hi, j, lo))
                for m, n in np.argwhere((i[:, None] <= j) & (lo <= hi[:, None] * max_ratio)).tolist():
                    x, y, out = sketch(i[m], data_i[m]), sketch(j[n], data_j[n]), []
                    at = [v.tolist() for v in candidates(x, y, min_share, max_ratio)]
                    if not at[0]:
                        continue
                    names, others, apart = keys_i[m].as_py(), keys_j[n].as_py(), i[m] != j[n]
                    for p, q in zip(*at):
                        if apart or p < q:
                            share = share_in_common(x.seqs[p], y.seqs[q], min_share, max_ratio)
                            if share >= min_share:
                                out.append((*sorted((names[p], others[q])), share))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.string(), pa.float64()))], ["a", "b", "share"])

    return x.select("blocks_i", "blocks_j").mapInArrow(run, "a string, b string, share double")


def follow(pointers: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root) from (id, up), up = id at the peaks, by pointer doubling."""
    for _ in range(rounds):
        step = pointers.select(F.col("id").alias("mid"), F.col("up").alias("higher"))
        nxt = materialise(
            pointers.select("id", "up").join(step.hint("merge"), F.col("up") == F.col("mid")).select("id", F.col("higher").alias("up"), (F.col("up") != F.col("higher")).alias("moved")),
            "pointers",
        )
        release(pointers)
        pointers = nxt
        if nxt.where("moved").isEmpty():
            return nxt.select("id", F.col("up").alias("root"))
    raise RuntimeError(f"the pointers did not settle in {rounds} rounds")


def density_clusters(seqs: DataFrame, *, min_share: float = 0.65, max_ratio: float = 2.0, part: int = PART) -> DataFrame:
    """(id, cluster, density long): every key of ``seqs`` (key, seq) with its cluster's peak.

    Keys without a similar record are clusters of their own, those with an empty sequence too.
    Equal sequences under several keys are similar records; ties in density go to the larger key.
    An empty table gives an empty result.
    """
    pairs = materialise(similar_pairs(seqs, min_share=min_share, max_ratio=max_ratio, part=part), "pairs")
    return _peaks(seqs, pairs)


def _peaks(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster, density) from all similar pairs.

    The distance of a record to the nearest denser one is 1 - share, and that of a record with no
    similar denser one lies beyond the limit: those are the peaks. The joins are hinted, so no side
    that grows with the records is broadcast.
    """
    close = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    density = materialise(close.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("density")), "density")
    a, b = (density.select(F.col("id").alias(n), F.col("density").alias(f"density_{n}")) for n in "ab")
    close = close.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(F.struct("density_b", "b") > F.struct("density_a", "a"))
    up = close.groupBy("a").agg(F.max_by("b", F.struct("share", "density_b", "b")).alias("up"))
    linked = materialise(density.select("id").join(up.hint("merge"), F.col("a") == F.col("id"), "left").select("id", F.coalesce("up", "id").alias("up")), "pointers")
    roots = follow(linked)
    x = seqs.select(F.col("key").alias("id")).join(roots.hint("merge"), "id", "left").join(density.hint("merge"), "id", "left")
    return x.select("id", F.coalesce("root", "id").alias("cluster"), F.coalesce("density", F.lit(0)).alias("density"))


def pairs_in_clusters(seqs: DataFrame, *, min_share: float = 0.65, max_ratio: float = 2.0, part: int = PART) -> DataFrame:
    """(a, b, share), a < b: the similar pairs whose two records are in one density cluster.

    The shares are those the neighbour joins have measured; nothing is compared again.
    """
    pairs = materialise(similar_pairs(seqs, min_share=min_share, max_ratio=max_ratio, part=part), "pairs")
    found = materialise(_peaks(seqs, pairs).where("density > 0").select("id", "cluster"), "clusters")
    a, b = (found.select(F.col("id").alias(n), F.col("cluster").alias(f"cluster_{n}")) for n in "ab")
    x = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    return x.where("cluster_a = cluster_b").select("a", "b", "share")


def describe_clusters(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, typical array<string>): the densest members of each cluster of two or more.

    The members are pre-aggregated in hashed parts, so no group is held by one task.
    """
    x = clusters.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256)))
    w = Window.partitionBy("cluster", "part").orderBy(F.col("density").desc(), F.col("id").desc())
    x = x.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("cluster", "part")))
    x = x.where(F.col("rn") <= typical)
    x = x.groupBy("cluster").agg(F.sum(F.when(F.col("rn") == 1, F.col("n"))).alias("size"), F.sort_array(F.collect_list(F.struct("density", "id")), asc=False).alias("m"))
    return x.where("size > 1").select("cluster", "size", F.transform(F.slice("m", 1, typical), lambda s: s["id"]).alias("typical"))


def cluster_pairs(clusters: DataFrame, seqs: DataFrame, *, min_share: float = 0.65, max_ratio: float = 2.0, part: int = PART) -> DataFrame:
    """(a, b, share), a < b: the similar pairs inside given clusters (id, cluster), each checked exactly.

    The pairs come from the blocked neighbour join, so a cluster of any size is many tasks.
    """
    pairs = similar_pairs(seqs, min_share=min_share, max_ratio=max_ratio, part=part)
    a, b = (clusters.select(F.col("id").alias(n), F.col("cluster").alias(f"cluster_{n}")) for n in "ab")
    x = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    return x.where("cluster_a = cluster_b").select("a", "b", "share")
