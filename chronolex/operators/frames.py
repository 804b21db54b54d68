"""Frame vectors: assembly, clustering, nearest centroids, masked losses, best epochs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions import numeric as N
from chronolex.shared import materialise

CLUSTERS = (5, 10, 15, 20, 25, 50, 75, 100, 200, 250, 300, 500)


def assemble(df: DataFrame, columns: list[str] | str, out: str = "features") -> DataFrame:
    """Scalar columns, or one array column, as an ML vector."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    if isinstance(columns, str):
        return df.withColumn(out, array_to_vector(F.transform(columns, lambda v: v.cast("double"))))
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def kmeans_labels(df: DataFrame, features: str, ks: tuple[int, ...] = CLUSTERS, seed: int = 0xDEAD, init_steps: int = 5, iterations: int = 20) -> tuple[DataFrame, dict[int, float]]:
    """``df`` with a column km{k} for each k, and the training cost of each.

    The vectors are written once to the shared folder; all fits read that. A k above the number of
    distinct vectors gives as many clusters as there are.
    """
    from pyspark.ml.clustering import KMeans

    out = df = materialise(df, "vectors")
    costs = {}
    for k in ks:
        model = KMeans(k=k, seed=seed, initSteps=init_steps, maxIter=iterations, featuresCol=features, predictionCol=f"km{k}").fit(df)
        costs[k] = model.summary.trainingCost
        out = model.transform(out)
    return out, costs


def minibatch_centres(df: DataFrame, vector: str, key: str, k: int, batch: int = 50_000, rounds: int = 6, seed: int = 0) -> DataFrame:
    """(label, centre): k centres fitted on one batch a round, each moved by the share of its new members.

    Rows are parted into batches of about ``batch`` by a hash of ``key``, taken in turn for as many
    rounds as there are batches, ``rounds`` at least, so every row is used. Sums a label are made
    where the rows are; the driver sees k sums a partition. The first centres are the k rows of
    smallest hash. Null vectors and keys play no part.
    """
    x = materialise(df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.transform(vector, lambda v: v.cast("double")).alias("v")), "batches")
    batches = max(1, -(-x.count() // batch))
    centres = np.array([r["v"] for r in x.orderBy("h", "v").limit(k).collect()])
    seen = np.zeros(len(centres))
    for r in range(max(rounds, batches) if len(centres) else 0):
        part = x.where(F.pmod("h", F.lit(batches)) == r % batches).select("v")
        got = part.mapInPandas(_sums_by_centre(centres), "label int, n long, s array<double>").collect()
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for row in got:
            total[row["label"]] += row["s"]
            n[row["label"]] += row["n"]
        new = n > 0
        seen += n
        centres = centres.copy()
        centres[new] += (total[new] - n[new, None] * centres[new]) / seen[new, None]
    return df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "label int, centre array<double>")


def _sums_by_centre(centres: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy())
            near = ((centres**2).sum(1)[None, :] - 2 * v @ centres.T).argmin(1)
            np.add.at(total, near, v)
            n += np.bincount(near, minlength=len(centres))
        used = np.flatnonzero(n)
        yield pd.DataFrame({"label": used, "n": n[used], "s": [total[i].tolist() for i in used]})

    return run


def with_centroids(df: DataFrame, centroids: DataFrame, label: str, centre: str, out: str, limit: int = 10_000) -> DataFrame:
    """``df`` with all centroids as one array of structs (l, c) on each row, in order of label.

    The array is one row, broadcast once an executor. More than ``limit`` centroids raise
    ValueError; without any the array is empty.
    """
    some = centroids.select(F.col(label).alias("l"), F.transform(centre, lambda v: v.cast("double")).alias("c")).limit(limit + 1)
    few = some.agg(F.array_sort(F.collect_list(F.struct("l", "c"))).alias(out), F.count("*").alias("__n"))
    few = materialise(few, "centroids")
    if few.first()["__n"] > limit:
        raise ValueError(f"more than {limit} centroids")
    few = few.select(out, F.lit(1).alias("__one"))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(few), "__one").drop("__one")


def nearest_centroid(df: DataFrame, vector: str, centroids: DataFrame, label: str, centre: str) -> DataFrame:
    """``df`` with the label of the nearest centroid, ties to the smallest label, and the distance."""
    x = with_centroids(df, centroids, label, centre, "__cs")
    far = F.transform("__cs", lambda c: F.struct(F.aggregate(F.zip_with(F.col(vector), c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"), c["l"].alias("l")))
    x = x.withColumn("__best", F.array_min(far))
    return x.withColumn("label", F.col("__best.l")).withColumn("distance", F.sqrt(F.col("__best.d"))).drop("__cs", "__best")


def masked_loss(df: DataFrame, logits: str, target: str, mask: str, weight: float = 1.0, reduction: str = "mean") -> DataFrame:
    """Losses and accuracies inside and outside the mask, and their convex mix.

    ``mean`` divides by the frames of a side, ``sum`` by the rows of the batch; others raise.
    """
    if reduction not in ("mean", "sum"):
        raise NotImplementedError(f"reduction {reduction}")
    ce = N.cross_entropy(F.col(logits), F.col(target))
    hit = (N.argmax(F.col(logits)) == F.col(target)).cast("int")
    x = df.select(ce.alias("ce"), hit.alias("hit"), F.col(mask).alias("m"))
    n = lambda c: F.count_if(c)
    by = (lambda c: n(c)) if reduction == "mean" else (lambda c: F.count("*"))
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("ce"))), F.lit(0.0)) / F.greatest(by(c), F.lit(1))
    right = lambda c: F.sum(F.when(c, F.col("hit"))) / n(c)
    m = F.col("m")
    out = x.agg(side(m).alias("loss_mask"), side(~m).alias("loss_unmask"), right(m).alias("acc_mask"), right(~m).alias("acc_unmask"), F.avg("hit").alias("acc"))
    return out.withColumn("loss", weight * F.col("loss_mask") + (1 - weight) * F.col("loss_unmask"))


def best_epoch(df: DataFrame, epoch: str, loss: str, accuracy: str) -> DataFrame:
    """Epochs of least loss, of best accuracy, and the last."""
    return df.agg(F.min_by(epoch, F.struct(loss, epoch)).alias("by_loss"), F.max_by(epoch, F.struct(F.col(accuracy), -F.col(epoch))).alias("by_accuracy"), F.max(epoch).alias("last"))


def trimmed(array: Column, n: Column) -> Column:
    """The first ``n`` frames."""
    return F.slice(array, F.lit(1), n)


def take_at(df: DataFrame, keys: list[str], order: list[str], at: int) -> DataFrame:
    """The at-th row (from 0) of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") == at + 1).drop("__rn")
