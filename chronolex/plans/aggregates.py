"""Queries of aggregations, ordered windows, packing and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.operators import batching, stats, timeline
from chronolex.operators.ranking import global_rank
from chronolex.plans.base import ALIGNED, SEG, WORDS, aligned, segments, words
from chronolex.plans.joins import _BUCKETS, _GRID, _ISLES, _buckets, _islands, stretches
from chronolex.plans.registry import query, table

S = SparkSession
D = DataFrame


@query(f"WITH {SEG} SELECT type, round(coalesce(sum(duration), 0) / 3600, 9) AS hours FROM seg GROUP BY type")
def duration_hours(spark: S, d: str) -> D:
    """Hours of sound by type."""
    return segments(spark, d).groupBy("type").agg(F.round(stats.hours(F.col("duration")), 9).alias("hours"))


@query(f"WITH {SEG} SELECT recording, list(idx ORDER BY idx) AS ids FROM seg GROUP BY recording")
def collect_segments(spark: S, d: str) -> D:
    """Sorted segment numbers of each recording."""
    return segments(spark, d).groupBy("recording").agg(F.sort_array(F.collect_list("idx")).alias("ids"))


_CLOCK = f"""WITH {SEG}, {_GRID}, clock AS (SELECT recording, idx, cnt, origin, duration, sum(duration) OVER (PARTITION BY recording ORDER BY idx ROWS UNBOUNDED PRECEDING) AS e FROM grid),
t AS (SELECT recording, idx, origin, cnt, e - duration AS s, e FROM clock)"""


def _clock(spark: S, d: str) -> D:
    """Stretches of the grid with start and end."""
    return timeline.running_clock(stretches(spark, d), "recording", "idx")


@query(_CLOCK + " SELECT recording, round(coalesce(sum(CASE WHEN origin = 0 THEN e - s END), 0), 3) AS missing, round(coalesce(sum(CASE WHEN origin = 1 THEN e - s END), 0), 3) AS fallback, round(coalesce(sum(CASE WHEN origin = 2 THEN e - s END), 0), 3) AS original FROM t GROUP BY recording")
def origin_durations(spark: S, d: str) -> D:
    """Seconds of each origin in a recording."""
    x = timeline.origin_durations(_clock(spark, d), "recording")
    return x.select("recording", *(F.round(c, 3).alias(c) for c in ("missing", "fallback", "original")))


@query(_CLOCK + " SELECT recording, idx, cnt, round(s, 3) AS start, round(e, 3) AS \"end\" FROM t")
def running_clock(spark: S, d: str) -> D:
    """Durations laid end to end; ``cnt`` missing indexes in a row are one stretch."""
    return _clock(spark, d).select("recording", "idx", "cnt", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _runs(src: str, out: str, least: float, order: str = "idx") -> str:
    return f"""{out}0 AS (SELECT *, CASE WHEN origin = lag(origin) OVER (PARTITION BY recording ORDER BY {order}) THEN 0 ELSE 1 END AS new FROM {src}),
{out}1 AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM {out}0),
{out} AS (SELECT recording, CAST(run AS BIGINT) AS run, CAST(sum(cnt) AS BIGINT) AS cnt, min(s) AS s, max(e) AS e, CASE WHEN max(e) - min(s) >= {least} THEN any_value(origin) ELSE 0 END AS origin FROM {out}1 GROUP BY recording, run)"""


_RUN_COLUMNS = " SELECT recording, run, cnt, round(s, 3) AS start, round(e, 3) AS \"end\", origin FROM "


def _rounded(x: D) -> D:
    return x.select("recording", "run", "cnt", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "origin")


@query(_CLOCK + ", " + _runs("t", "r", 0) + _RUN_COLUMNS + "r")
def merge_runs(spark: S, d: str) -> D:
    """Neighbours of one origin merged."""
    return _rounded(timeline.merge_runs(_clock(spark, d), "recording", "idx"))


@query(_CLOCK + ", " + _runs("t", "r", 12.3456) + _RUN_COLUMNS + "r")
def merge_runs_constrained(spark: S, d: str) -> D:
    """Runs shorter than a bound count as missing."""
    return _rounded(timeline.merge_runs(_clock(spark, d), "recording", "idx", least=12.3456))


@query(_CLOCK + ", " + _runs("t", "r", 0) + ", used AS (SELECT recording, run AS ord, cnt, s, e, CASE WHEN origin <> 0 THEN 1 ELSE 0 END AS origin FROM r), " + _runs("used", "q", 20.00005, "ord") + _RUN_COLUMNS + "q")
def two_stage_merge(spark: S, d: str) -> D:
    """Runs of origins, then of used and missing."""
    return _rounded(timeline.two_stage_merge(_clock(spark, d), "recording", "idx", 20.00005))


@query(_ISLES + ' SELECT recording, "start", "end", cnt FROM i')
def islands(spark: S, d: str) -> D:
    """Runs of consecutive segment numbers."""
    return _islands(spark, d)


@query(f"WITH {SEG} SELECT recording, min(idx) AS lowest, max(idx) AS highest, min(duration) AS shortest, max(duration) AS longest FROM seg GROUP BY recording")
def minmax(spark: S, d: str) -> D:
    """Extremes per recording."""
    return segments(spark, d).groupBy("recording").agg(F.min("idx").alias("lowest"), F.max("idx").alias("highest"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"))


@query("SELECT split_part(path, '/', 1) AS recording, count(DISTINCT split_part(path, '/', 2)) AS segments FROM cluster_labels GROUP BY 1")
def distinct_keys(spark: S, d: str) -> D:
    """Distinct segments a recording."""
    p = F.split("path", "/")
    return table(spark, d, "cluster_labels").groupBy(p[0].alias("recording")).agg(F.count_distinct(p[1]).alias("segments"))


@query("SELECT count(*) AS n FROM cluster_labels")
def row_count(spark: S, d: str) -> D:
    """Rows of a table."""
    return table(spark, d, "cluster_labels").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT lower(word) AS form, count(*) AS n FROM wrd GROUP BY 1 HAVING count(*) > 3")
def key_counts(spark: S, d: str) -> D:
    """Frequencies of repeated keys."""
    return words(spark, d).groupBy(F.lower("word").alias("form")).agg(F.count("*").alias("n")).where("n > 3")


_stat = lambda c: f"avg({c}) AS a, stddev_samp({c}) AS s, median({c}) AS m, quantile_cont({c}, 0.6) AS p60, quantile_cont({c}, 0.7) AS p70, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.8) AS p80, quantile_cont({c}, 0.9) AS p90"
_STATS = ", ".join(f"round({a}, 10) AS {b}" for a, b in (("a", "avg_char_duration"), ("s", "std_char_duration"), ("m", "median_char_duration"), ("p60", "char_duration_60"), ("p70", "char_duration_70"), ("p75", "char_duration_75"), ("p80", "char_duration_80"), ("p90", "char_duration_90")))


@query(f"WITH {WORDS} SELECT segm, {_STATS} FROM (SELECT segm, {_stat('avg_char_duration')} FROM (SELECT segm, CASE WHEN NOT isnan(avg_char_duration) THEN avg_char_duration END AS avg_char_duration FROM wrd) GROUP BY segm)")
def segment_stats(spark: S, d: str) -> D:
    """Mean, deviation, median and percentiles of a measure in each segment."""
    x = words(spark, d).groupBy("segm").agg(*stats.describe(F.col("avg_char_duration"), "char_duration"))
    return x.select("segm", *(F.round(c, 10).alias(c) for c in x.columns[1:]))


@query(f"WITH {ALIGNED} SELECT recording, count(*) AS words, CAST(count(*) FILTER (WHERE NOT recognized) AS DOUBLE) / count(*) AS missed_words, sum(CASE WHEN NOT recognized THEN length(true_w) ELSE 0 END) / CAST(sum(length(true_w)) AS DOUBLE) AS missed_chars FROM ali GROUP BY recording")
def missed_ratio(spark: S, d: str) -> D:
    """Shares of words and characters not recognised."""
    lost = ~F.col("recognized")
    return aligned(spark, d).groupBy("recording").agg(
        F.count("*").alias("words"), (F.count_if(lost) / F.count("*")).alias("missed_words"), (F.sum(F.when(lost, F.length("true_w")).otherwise(0)) / F.sum(F.length("true_w"))).alias("missed_chars")
    )


@query(f"WITH {ALIGNED} SELECT recording, avg(CASE WHEN trans_w = true_w THEN 1.0 ELSE 0.0 END) AS accuracy FROM ali GROUP BY recording")
def accuracy(spark: S, d: str) -> D:
    """Share of words recognised as they are."""
    hit = (F.coalesce(F.col("trans_w") == F.col("true_w"), F.lit(False))).cast("int").cast("double")
    return aligned(spark, d).groupBy("recording").agg(F.avg(hit).alias("accuracy"))


@query(f"WITH {ALIGNED} SELECT recording, sum(CASE WHEN joined AND trans_w = true_w THEN 1 ELSE 0 END) / CAST(nullif(count(*) FILTER (WHERE joined), 0) AS DOUBLE) AS inside, sum(CASE WHEN NOT joined AND trans_w = true_w THEN 1 ELSE 0 END) / CAST(nullif(count(*) FILTER (WHERE NOT joined), 0) AS DOUBLE) AS outside FROM ali GROUP BY recording")
def masked_accuracy(spark: S, d: str) -> D:
    """Accuracy inside and outside a mask."""
    hit = F.coalesce(F.col("trans_w") == F.col("true_w"), F.lit(False))
    part = lambda m: F.count_if(m & hit) / F.nullif(F.count_if(m), F.lit(0))
    return aligned(spark, d).groupBy("recording").agg(part(F.col("joined")).alias("inside"), part(~F.col("joined")).alias("outside"))


@query(f"WITH {SEG} SELECT round(avg(m), 9) AS mean_of_means FROM (SELECT avg(m) AS m FROM (SELECT type, recording, avg(coverage) AS m FROM seg GROUP BY 1, 2) GROUP BY type)")
def mean_of_means(spark: S, d: str) -> D:
    """Means of recordings, their mean by type, the mean of those."""
    return stats.mean_of_means(segments(spark, d), "type", "recording", "coverage").select(F.round("mean_of_means", 9).alias("mean_of_means"))


_ITEMS = f"items AS (SELECT type, recording || '/' || CAST(idx AS VARCHAR) AS k, words AS s, row_number() OVER (PARTITION BY type ORDER BY recording || '/' || CAST(idx AS VARCHAR)) AS rn, sum(words) OVER (PARTITION BY type) AS total FROM seg)"
_FOLD = lambda limit: f"f(type, rn, acc, bin) AS (SELECT type, 0, 0, 0 FROM (SELECT DISTINCT type FROM items) UNION ALL SELECT i.type, CAST(i.rn AS INT), CAST(CASE WHEN f.acc + i.s >= {limit} THEN 0 ELSE f.acc + i.s END AS INT), CASE WHEN f.acc + i.s >= {limit} THEN f.bin + 1 ELSE f.bin END FROM f JOIN items i ON i.type = f.type AND i.rn = f.rn + 1)"


def _items(spark: S, d: str) -> D:
    """Segments of all types."""
    return segments(spark, d).select("type", F.concat_ws("/", "recording", F.col("idx").cast("string")).alias("k"), F.col("words").alias("s"))


@query(f"WITH RECURSIVE {SEG}, {_ITEMS}, {_FOLD('i.total / 4.0')} SELECT i.type, CAST(p.bin AS BIGINT) AS bin, i.k, CAST(i.s AS DOUBLE) AS s FROM items i JOIN f p ON p.type = i.type AND p.rn = i.rn - 1")
def greedy_bins(spark: S, d: str) -> D:
    """Bins that close once they reach a quarter of the group's total."""
    return batching.greedy_bins(_items(spark, d), "k", "s", bins=4, group=["type"])


@query(f"WITH RECURSIVE {SEG}, {_ITEMS}, {_FOLD('100')} SELECT i.type, CAST(p.bin AS BIGINT) AS file, i.k, CAST(i.s AS DOUBLE) AS s FROM items i JOIN f p ON p.type = i.type AND p.rn = i.rn - 1")
def flush_chunks(spark: S, d: str) -> D:
    """Output files of a buffer flushed at a hundred words."""
    return batching.flush_chunks(_items(spark, d), "k", "s", 100, group=["type"])


@query(f"WITH {SEG}, {_BUCKETS} SELECT recording, bucket FROM b")
def fixed_buckets(spark: S, d: str) -> D:
    """Recordings in order, as many a bucket."""
    return _buckets(spark, d)


@query(f"WITH {SEG} SELECT recording, CAST(floor(floor(sum(duration)) / 60) AS BIGINT) || ':' || CAST(CAST(floor(sum(duration)) AS BIGINT) % 60 AS VARCHAR) AS length FROM seg WHERE duration IS NOT NULL GROUP BY recording")
def format_duration(spark: S, d: str) -> D:
    """Minutes and seconds."""
    return segments(spark, d).where("duration is not null").groupBy("recording").agg(stats.minutes_seconds(F.sum("duration")).alias("length"))


@query("SELECT DISTINCT segm, word, speaker, start_time FROM words")
def dedup_rows(spark: S, d: str) -> D:
    """Distinct rows."""
    return table(spark, d, "words").select("segm", "word", "speaker", "start_time").dropDuplicates()


@query(f"WITH {SEG} SELECT recording, idx, max(duration) OVER (PARTITION BY recording) AS longest FROM seg")
def group_transform(spark: S, d: str) -> D:
    """A group's maximum on each of its rows."""
    return segments(spark, d).select("recording", "idx", F.max("duration").over(Window.partitionBy("recording")).alias("longest"))


@query(f"WITH {SEG} SELECT recording, idx, row_number() OVER (PARTITION BY type ORDER BY recording, idx) - 1 AS id, type FROM seg")
def sort_reindex(spark: S, d: str) -> D:
    """New row ids in order, a sequence for each type."""
    x = global_rank(segments(spark, d).select("recording", "idx", "type"), ["type", "recording", "idx"], "at")
    first = x.groupBy(F.col("type").alias("t")).agg(F.min("at").alias("first"))
    return x.join(first, F.col("type").eqNullSafe(F.col("t"))).select("recording", "idx", (F.col("at") - F.col("first")).alias("id"), "type")


@query(f"WITH {SEG}, f AS (SELECT recording, idx, unnest(range(0, words)) AS frame FROM seg) SELECT recording, idx, frame, recording || '/' || CAST(idx AS VARCHAR) || '/' || CAST(frame AS VARCHAR) AS path FROM f")
def frame_ids(spark: S, d: str) -> D:
    """Frames numbered inside their segment, of all segments."""
    x = segments(spark, d).where("words > 0").select("recording", "idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1)).alias("frame"))
    return x.withColumn("path", F.concat_ws("/", "recording", F.col("idx").cast("string"), F.col("frame").cast("string")))


_SAMPLER = f"""WITH {SEG}, x AS (SELECT recording AS folder, recording || '/' || CAST(idx AS VARCHAR) AS item, coalesce(duration, 0) AS duration, row_number() OVER (ORDER BY idx, recording) AS position FROM seg),
s AS (SELECT folder, min(position) AS seen, count(*) AS c FROM x GROUP BY folder), tot AS (SELECT count(*) AS n FROM x),
x1 AS (SELECT x.*, seen, row_number() OVER (PARTITION BY x.folder ORDER BY position) - 1 AS o FROM x JOIN s USING (folder)),
pad AS (SELECT CAST(ceil(n / 3.0) * 3 - n AS BIGINT) AS p FROM tot),
h AS (SELECT * FROM x1 WHERE seen = (SELECT min(seen) FROM s)), hn AS (SELECT count(*) AS c FROM h),
x2 AS (SELECT folder, item, duration, seen, o FROM x1 UNION ALL SELECT folder, item, duration, seen, o + hn.c FROM h, hn, pad WHERE o < p),
x3 AS (SELECT *, o // 24 AS block, row_number() OVER (PARTITION BY seen, o // 24 ORDER BY duration, o) - 1 AS q FROM x2),
b AS (SELECT seen, sum(count(*)) OVER (ORDER BY seen) - count(*) AS base FROM x2 GROUP BY seen),
p AS (SELECT CAST(base + block * 24 + q AS BIGINT) AS pos, folder, item, duration FROM x3 JOIN b USING (seen))"""


def _sampler(spark: S, d: str, **more) -> D:
    x = segments(spark, d)
    x = global_rank(x.select("recording", "idx", "duration"), ["idx", "recording"], "position")
    x = x.select(F.col("recording").alias("folder"), F.concat_ws("/", "recording", F.col("idx").cast("string")).alias("item"), F.coalesce("duration", F.lit(0.0)).alias("duration"), "position")
    return batching.bucketed_sampler(x, folder="folder", item="item", duration="duration", position="position", batch=4, replicas=3, scale=2, **more)


@query(_SAMPLER + " SELECT pos, folder, item, duration FROM p")
def bucketed_sampler(spark: S, d: str) -> D:
    """Folders in turn, chunks sorted by duration."""
    return _sampler(spark, d).select("pos", "folder", "item", "duration")


@query(_SAMPLER + " SELECT count(*) AS positions, count(DISTINCT item) AS items, max(pos) AS last FROM p")
def sampler_pad(spark: S, d: str) -> D:
    """Positions after padding to a multiple of the replicas."""
    return _sampler(spark, d).agg(F.count("*").alias("positions"), F.count_distinct("item").alias("items"), F.max("pos").alias("last"))


@query(_SAMPLER + ", q AS (SELECT n, CAST(CASE WHEN n % 3 <> 0 THEN ceil((n - 3) / 3.0) * 3 ELSE n END AS BIGINT) AS t FROM tot), kept AS (SELECT CAST(base + block * 24 + qq AS BIGINT) AS pos FROM (SELECT seen, o // 24 AS block, row_number() OVER (PARTITION BY seen, o // 24 ORDER BY duration, o) - 1 AS qq FROM x1) JOIN (SELECT seen, sum(count(*)) OVER (ORDER BY seen) - count(*) AS base FROM x1 GROUP BY seen) USING (seen)) SELECT count(*) AS positions, max(pos) AS last FROM kept, q WHERE pos < t")
def sampler_drop_last(spark: S, d: str) -> D:
    """Positions when the incomplete turn is dropped."""
    return _sampler(spark, d, drop_last=True).agg(F.count("*").alias("positions"), F.max("pos").alias("last"))


@query(_SAMPLER + " SELECT pos % 3 AS rank, pos // 3 AS turn, item FROM p")
def strided_shard(spark: S, d: str) -> D:
    """What each replica sees and when."""
    return _sampler(spark, d).select("rank", "turn", "item")


@query()
def sampler_epoch(spark: S, d: str) -> D:
    """A shuffled epoch: every item, in an order of seed and epoch."""
    return _sampler(spark, d, seed=11, epoch=3).select("pos", "item")


@query(f"WITH {SEG} SELECT recording, idx, duration FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY duration DESC, idx) AS rn FROM seg WHERE duration IS NOT NULL) WHERE rn <= 3")
def top_k_per_key(spark: S, d: str) -> D:
    """The three longest segments of each recording."""
    w = Window.partitionBy("recording").orderBy(F.desc("duration"), "idx")
    return segments(spark, d).where("duration is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("recording", "idx", "duration")


@query(f"WITH {SEG} SELECT recording, idx, speakers FROM (SELECT *, rank() OVER (PARTITION BY recording ORDER BY speakers DESC) AS r FROM seg) WHERE r = 1")
def best_ties(spark: S, d: str) -> D:
    """All segments that share the best score."""
    w = Window.partitionBy("recording").orderBy(F.desc("speakers"))
    return segments(spark, d).withColumn("r", F.rank().over(w)).where("r = 1").select("recording", "idx", "speakers")
