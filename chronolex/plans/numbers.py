"""Queries of numeric and array functions, frame vectors and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import audio
from chronolex.functions import numeric as N
from chronolex.operators import frames
from chronolex.operators.ranking import global_rank
from chronolex.plans.base import SEG, segments
from chronolex.plans.registry import query, table

S = SparkSession
D = DataFrame


@query(f"WITH {SEG} SELECT recording, idx, list_transform(range(0, 15), lambda i: CAST((idx // CAST(10 ** i AS BIGINT)) % 10 AS INT)) AS digits FROM seg")
def digit_orders(spark: S, d: str) -> D:
    """Digits of a number by order."""
    return segments(spark, d).select("recording", "idx", N.digit_orders(F.col("idx")).alias("digits"))


_MS = "CAST(floor(words * 777 / 16000.0 * 1000) AS BIGINT)"


@query(f"WITH {SEG} SELECT recording, idx, CAST(floor(({_MS} - {_MS} % 5 - 1) / 20.0) AS BIGINT) AS frames FROM seg")
def frame_count(spark: S, d: str) -> D:
    """Frames of 20 ms."""
    return segments(spark, d).select("recording", "idx", N.frame_count(F.col("words") * 777, F.lit(16000.0)).alias("frames"))


@query(f"WITH {SEG} SELECT recording, idx, CAST(floor(words * 777 * 2 / 640.0) + 1 AS BIGINT) AS frames FROM seg")
def frame_count_stft(spark: S, d: str) -> D:
    """Frames of a centred transform."""
    return segments(spark, d).select("recording", "idx", N.frame_count_stft(F.col("words") * 777, F.lit(640.0)).alias("frames"))


@query("SELECT e AS epoch, CASE WHEN e < 5.0 THEN e / 5.0 ELSE (50.0 - e) / 45.0 END AS rate FROM (SELECT CAST(unnest(range(0, 51)) AS DOUBLE) AS e)")
def lr_schedule(spark: S, d: str) -> D:
    """Warm-up and decay by epoch."""
    return spark.range(51).select(F.col("id").cast("double").alias("epoch")).withColumn("rate", N.learning_rate(F.col("epoch"), 50.0, 0.1))


@query("SELECT h AS hour, CAST(CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END AS BIGINT) AS dial, CAST(CASE WHEN (h + 1) % 12 = 0 THEN 12 ELSE (h + 1) % 12 END AS BIGINT) AS next FROM (SELECT unnest(range(0, 25)) AS h)")
def clock_12h(spark: S, d: str) -> D:
    """Hours on a 12-hour dial."""
    return spark.range(25).select(F.col("id").alias("hour"), N.clock_12h(F.col("id")).cast("long").alias("dial"), N.clock_12h(F.col("id"), 1).cast("long").alias("next"))


@query("SELECT file_id, coalesce(n_bytes, -1) AS n_bytes, segm IS NULL AS missing FROM segment_files")
def fill_default(spark: S, d: str) -> D:
    """Defaults in place of nulls."""
    return table(spark, d, "segment_files").select("file_id", F.coalesce("n_bytes", F.lit(-1).cast("long")).alias("n_bytes"), F.col("segm").isNull().alias("missing"))


_LISTS = f"WITH {SEG}, l AS (SELECT recording, list(words ORDER BY idx) AS w FROM seg GROUP BY recording)"


def _lists(spark: S, d: str) -> D:
    x = segments(spark, d).groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("idx", "words"))).alias("w"))
    return x.select("recording", F.col("w.words").alias("w"))


@query(_LISTS + " SELECT recording, w[2:4] AS part, list_concat(w, w) AS twice, range(0, len(w)) AS positions FROM l")
def array_ops(spark: S, d: str) -> D:
    """Slices, repetition and ranges of arrays."""
    n = F.size("w")
    return _lists(spark, d).select("recording", F.slice("w", 2, 3).alias("part"), F.flatten(F.array_repeat("w", 2)).alias("twice"), F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")).alias("positions"))


@query(_LISTS + ", r AS (SELECT *, (row_number() OVER (ORDER BY recording NULLS FIRST) - 1) // 8 AS batch FROM l) SELECT recording, batch, list_concat(w, list_transform(range(0, max(len(w)) OVER (PARTITION BY batch) - len(w)), lambda i: CAST(-1 AS BIGINT))) AS padded, len(w) AS length FROM r")
def pad_batch(spark: S, d: str) -> D:
    """Batches of eight arrays, each padded to the longest of its batch, with their lengths."""
    x = global_rank(_lists(spark, d), ["recording"], "at").withColumn("batch", F.floor(F.col("at") / 8))
    return x.select("recording", "batch", N.pad_batch(F.col("w"), F.col("batch"), F.lit(-1).cast("long")).alias("padded"), F.size("w").cast("long").alias("length"))


@query(_LISTS + " SELECT recording, list_concat(list_concat(list_reverse(w[2:3]), w), list_reverse(w[len(w) - 2:len(w) - 1])) AS padded FROM l WHERE len(w) > 3")
def reflect_pad(spark: S, d: str) -> D:
    """Mirrored values on both sides."""
    x = _lists(spark, d).where("size(w) > 3")
    return x.select("recording", N.reflect_pad(F.col("w"), 2).alias("padded"))


@query(f"WITH {SEG} SELECT recording, count(*) AS n, min(w) AS third FROM (SELECT recording, (list(words ORDER BY idx) OVER (PARTITION BY recording))[3] AS w FROM seg) GROUP BY recording")
def map_lookup(spark: S, d: str) -> D:
    """A map from place to value of each recording, built from its first places, and a lookup in it."""
    at = F.row_number().over(Window.partitionBy("recording").orderBy("idx"))
    x = segments(spark, d).select("recording", "words", at.alias("at")).groupBy("recording")
    first = F.when(F.col("at") <= 3, F.struct("at", "words"))
    x = x.agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(first)).alias("m"))
    return x.select("recording", "n", F.try_element_at("m", F.lit(3)).alias("third"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_explode(spark: S, d: str) -> D:
    """Values of nested JSON as rows."""
    x = table(spark, d, "events").select("event_id", F.from_json(F.concat(F.lit("[["), "props", F.lit("]]")), "array<array<struct<k:bigint>>>").alias("j"))
    return x.select("event_id", F.explode("j").alias("a")).select("event_id", F.explode("a").alias("s")).select("event_id", "s.k")


@query("SELECT vec_id, CAST(list_extract(embedding, 1) AS DOUBLE) AS first, len(embedding) AS size FROM embeddings")
def assemble_features(spark: S, d: str) -> D:
    """Scalars as one vector."""
    from pyspark.ml.functions import vector_to_array

    x = table(spark, d, "embeddings")
    x = x.select("vec_id", *(F.get("embedding", i).cast("double").alias(f"f{i}") for i in range(64)))
    v = vector_to_array("features")
    return frames.assemble(x, [f"f{i}" for i in range(64)]).select("vec_id", F.get(v, 0).alias("first"), F.size(v).cast("long").alias("size"))


@query()
def kmeans_labels(spark: S, d: str) -> D:
    """Cluster labels of the vectors, a column for each of the twelve k."""
    x = frames.assemble(table(spark, d, "embeddings"), "embedding")
    return frames.kmeans_labels(x, "features")[0].select("vec_id", *(f"km{k}" for k in frames.CLUSTERS))


@query()
def kmeans_cost(spark: S, d: str) -> D:
    """Training cost for each of the twelve k."""
    x = frames.assemble(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame(sorted(frames.kmeans_labels(x, "features")[1].items()), "k int, cost double")


@query()
def kmeans_minibatch(spark: S, d: str) -> D:
    """Cluster labels from centres fitted batch by batch, for three k."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    for k in (10, 25, 50):
        centres = frames.minibatch_centres(x, "embedding", "vec_id", k)
        x = frames.nearest_centroid(x, "embedding", centres, "label", "centre").withColumnRenamed("label", f"km{k}").drop("distance")
    return x.select("vec_id", "km10", "km25", "km50")


_CENTRES = "c AS (SELECT label AS l, embedding AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"


def _centres(spark: S, d: str) -> D:
    x = table(spark, d, "embeddings")
    return x.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))


@query(f"WITH {_CENTRES}, p AS (SELECT vec_id, l, list_sum(list_transform(list_zip(embedding, e), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS dist FROM embeddings, c) SELECT vec_id, l AS label FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), l) = 1")
def nearest_centroid(spark: S, d: str) -> D:
    """The nearest centroid of each vector."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    return frames.nearest_centroid(x, "embedding", _centres(spark, d), "label", "centre").select("vec_id", "label")


_COS = "list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) * sqrt(list_sum(list_transform(e, lambda v: CAST(v AS DOUBLE) * v)))) / 0.1"


@query(f"WITH {_CENTRES} SELECT vec_id, l AS label, round({_COS}, 5) AS score FROM embeddings, c")
def cosine_scores(spark: S, d: str) -> D:
    """Cosine of each vector and each centroid over a temperature."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    x = frames.with_centroids(x, _centres(spark, d), "label", "centre", "cs").select("vec_id", "embedding", F.explode("cs").alias("c"))
    return x.select("vec_id", F.col("c.l").alias("label"), F.round(N.cosine(F.col("embedding"), F.col("c.c"), 0.1), 5).alias("score"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def argmax_label(spark: S, d: str) -> D:
    """Position of the largest value."""
    return table(spark, d, "embeddings").select("vec_id", N.argmax(F.col("embedding")).cast("long").alias("best"))


_LOGITS = "lg AS (SELECT vec_id, label AS target, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS x, vec_id % 3 = 0 AS m FROM embeddings), ce AS (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[target + 1] AS ce, CAST(list_position(x, list_max(x)) - 1 = target AS INT) AS hit FROM lg)"


def _logits(spark: S, d: str) -> D:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("target"), F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double")).alias("x"), (F.pmod("vec_id", F.lit(3)) == 0).alias("m"))


@query(f"WITH {_LOGITS} SELECT vec_id, round(ce, 6) AS loss FROM ce")
def cross_entropy(spark: S, d: str) -> D:
    """-log softmax of the target."""
    return _logits(spark, d).select("vec_id", F.round(N.cross_entropy(F.col("x"), F.col("target")), 6).alias("loss"))


@query(f"WITH {_LOGITS}, a AS (SELECT avg(ce) FILTER (WHERE m) AS lm, avg(ce) FILTER (WHERE NOT m) AS lu, avg(hit) FILTER (WHERE m) AS am, avg(hit) FILTER (WHERE NOT m) AS au, avg(hit) AS acc FROM ce) SELECT round(lm, 6) AS loss_mask, round(lu, 6) AS loss_unmask, round(am, 6) AS acc_mask, round(au, 6) AS acc_unmask, round(acc, 6) AS acc, round(0.7 * lm + 0.3 * lu, 6) AS loss FROM a")
def masked_loss(spark: S, d: str) -> D:
    """Losses and accuracies inside and outside the mask, and their mix."""
    x = frames.masked_loss(_logits(spark, d), "x", "target", "m", weight=0.7)
    return x.select(*(F.round(c, 6).alias(c) for c in x.columns))


@query(_LISTS + " SELECT recording, w[1:3] AS frames FROM l")
def trim_frames(spark: S, d: str) -> D:
    """The first frames of an array."""
    return _lists(spark, d).select("recording", frames.trimmed(F.col("w"), F.lit(3)).alias("frames"))


@query(_LISTS + " SELECT recording, list_filter(list_sort(list_distinct(list_concat(range(2, 5), range(9, 12)))), lambda p: p < len(w)) AS masked, list_transform(range(0, len(w)), lambda i: CASE WHEN i BETWEEN 2 AND 4 OR i BETWEEN 9 AND 11 THEN 0 ELSE w[i + 1] END) AS kept FROM l")
def span_mask(spark: S, d: str) -> D:
    """Spans of three from given starts, masked by 0."""
    at = N.span_mask(F.size("w"), F.array(F.lit(2), F.lit(9)), 3)
    return _lists(spark, d).select("recording", F.transform(at, lambda p: p.cast("long")).alias("masked"), N.masked(F.col("w"), at, F.lit(0).cast("long")).alias("kept"))


@query()
def random_span_mask(spark: S, d: str) -> D:
    """Spans from seeded random starts."""
    starts = N.random_starts(F.size("w"), F.col("recording"), 0.2, 3, seed=5)
    return _lists(spark, d).select("recording", N.span_mask(F.size("w"), starts, 3).alias("masked"))


@query("WITH e AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS epoch, avg(value) AS loss, max(value) AS acc FROM events GROUP BY 1) SELECT arg_min(epoch, loss) AS by_loss, arg_max(epoch, acc) AS by_accuracy, max(epoch) AS last FROM (SELECT CAST(epoch - DATE '2000-01-01' AS BIGINT) AS epoch, round(loss, 6) AS loss, acc FROM e)")
def best_epoch(spark: S, d: str) -> D:
    """Epochs of least loss and of best accuracy, and the last."""
    day = F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")).cast("long")
    x = table(spark, d, "events").groupBy(day.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"), F.max("value").alias("acc"))
    return frames.best_epoch(x, "epoch", "loss", "acc")


@query("SELECT vec_id, list_transform(range(1, 33), lambda i: (CAST(embedding[i] AS DOUBLE) + embedding[i + 32]) / 2) AS mono FROM embeddings")
def to_mono(spark: S, d: str) -> D:
    """Two channels averaged."""
    both = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return table(spark, d, "embeddings").select("vec_id", N.to_mono(both).alias("mono"))


@query()
def mfcc_features(spark: S, d: str) -> D:
    """Features of short waveforms."""
    x = table(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 30)).alias("wave"))
    return x.select("vec_id", F.size(audio.mfcc_frames(F.col("wave"), 16_000)).alias("frames"))


@query()
def resampled_waves(spark: S, d: str) -> D:
    """Waveforms at twice their rate."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    return x.select("vec_id", F.size(audio.resampled(F.col("embedding").cast("array<double>"), F.lit(8000), 16_000)).alias("samples"))
