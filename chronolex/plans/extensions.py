"""Beyond the surveyed operators: grouping sets, ranking windows, set operations, as-of joins, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.operators import relational as rel
from chronolex.plans.base import ALIGNED, SEG, WORDS, aligned, segments, words
from chronolex.plans.registry import query, table
from chronolex.shared import fresh_path
from chronolex.streaming import windows

S = SparkSession
D = DataFrame


@query(f"WITH {SEG} SELECT type, speakers, CAST(grouping(type) * 2 + grouping(speakers) AS BIGINT) AS level, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM seg GROUP BY CUBE (type, speakers)")
def x_cube(spark: S, d: str) -> D:
    """Counts over all combinations of two keys."""
    return segments(spark, d).cube("type", "speakers").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("words").alias("words"))


@query(f"WITH {SEG} SELECT recording, type, count(*) AS n FROM seg GROUP BY ROLLUP (recording, type)")
def x_rollup(spark: S, d: str) -> D:
    """Counts by recording, by type within it, and in all."""
    return segments(spark, d).rollup("recording", "type").agg(F.count("*").alias("n"))


@query(f"WITH {SEG} SELECT type, speakers, count(*) AS n FROM seg GROUP BY GROUPING SETS ((type), (speakers), ())")
def x_grouping_sets(spark: S, d: str) -> D:
    """Counts for chosen sets of keys."""
    x = segments(spark, d)
    return x.groupingSets([[F.col("type")], [F.col("speakers")], []], "type", "speakers").agg(F.count("*").alias("n"))


@query(f"WITH {SEG} SELECT recording, idx, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w2 AS quarter, lead(words) OVER w2 AS next, first_value(words) OVER w2 AS first FROM seg WINDOW w AS (PARTITION BY recording ORDER BY words DESC), w2 AS (PARTITION BY recording ORDER BY idx)")
def x_ranking(spark: S, d: str) -> D:
    """Ranking and offset functions."""
    w, w2 = Window.partitionBy("recording").orderBy(F.desc("words")), Window.partitionBy("recording").orderBy("idx")
    x = segments(spark, d).select("recording", "idx", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w2).alias("quarter"), F.lead("words").over(w2).alias("next"), F.first("words").over(w2).alias("first"))
    return x.select("recording", "idx", *(F.col(c).cast("long").alias(c) for c in ("r", "dr", "quarter", "next", "first")))


@query(f"WITH {SEG} SELECT recording, idx, CAST(sum(words) OVER (PARTITION BY recording ORDER BY idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS near, CAST(max(words) OVER (PARTITION BY recording ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS peak FROM seg")
def x_frames(spark: S, d: str) -> D:
    """Range and row frames."""
    w = Window.partitionBy("recording").orderBy("idx")
    return segments(spark, d).select("recording", "idx", F.sum("words").over(w.rangeBetween(-3, 0)).alias("near"), F.max("words").over(w.rowsBetween(-1, 1)).alias("peak"))


@query(f"WITH {WORDS}, {ALIGNED} SELECT word_id AS id FROM wrd INTERSECT SELECT id FROM ali")
def x_intersect(spark: S, d: str) -> D:
    """Ids of both tables."""
    return words(spark, d).select(F.col("word_id").alias("id")).intersect(aligned(spark, d).select("id"))


@query(f"WITH {WORDS}, {ALIGNED} SELECT lower(word) AS form FROM wrd EXCEPT ALL SELECT true_w FROM ali")
def x_except_all(spark: S, d: str) -> D:
    """Forms left when each of the other table takes one away."""
    return words(spark, d).select(F.lower("word").alias("form")).exceptAll(aligned(spark, d).select("true_w"))


@query(f"WITH {WORDS}, {ALIGNED} SELECT coalesce(word_id, id) AS id, word, true_w FROM wrd FULL JOIN ali ON id = word_id")
def x_full_outer(spark: S, d: str) -> D:
    """Rows of both tables, matched or not."""
    return words(spark, d).join(aligned(spark, d), F.col("id") == F.col("word_id"), "full").select(F.coalesce("word_id", "id").alias("id"), "word", "true_w")


@query("""SELECT e.event_id, e.user_id, p.value AS bought FROM (SELECT *, ROW_NUMBER() OVER () AS z FROM events) e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def x_as_of(spark: S, d: str) -> D:
    """Each event with the latest value of one type so far."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    kind = e.agg(F.min("event_type")).first()[0]
    p = e.where(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return rel.as_of_join(e.select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "ts", "value", "bought").select("event_id", "user_id", "bought")


@query(f"WITH {SEG} SELECT recording, count(*) FILTER (WHERE type = 'train') AS train, count(*) FILTER (WHERE type = 'other') AS other FROM seg GROUP BY recording")
def x_pivot(spark: S, d: str) -> D:
    """Types as columns."""
    x = segments(spark, d).groupBy("recording").pivot("type", ["train", "other"]).agg(F.count(F.lit(1)))
    return x.fillna(0, ["train", "other"])


@query(f"WITH {SEG} SELECT type, count(DISTINCT recording) AS n FROM seg WHERE words > (SELECT avg(words) FROM seg) GROUP BY type")
def x_subquery(spark: S, d: str) -> D:
    """A scalar subquery in SQL text over a view."""
    return spark.sql("SELECT type, count(DISTINCT recording) AS n FROM {seg} WHERE words > (SELECT avg(words) FROM {seg}) GROUP BY type", seg=segments(spark, d))


@query()
def x_sketches(spark: S, d: str) -> D:
    """Approximate distinct counts and quantiles by type."""
    return segments(spark, d).groupBy("type").agg(F.approx_count_distinct("recording", 0.02).alias("recordings"), F.percentile_approx("duration", [0.5, 0.9], 1000).alias("quantiles"))


_EV = "events"
_W = "time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')"


@query(f"SELECT event_type, {_W} AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_tumbling(spark: S, d: str) -> D:
    """Events by hour."""
    x = windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")
    return x.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"WITH h AS (SELECT unnest([0, 1]) AS h), w AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - h * INTERVAL '30 minutes' AS start, value FROM events, h) SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def x_sliding(spark: S, d: str) -> D:
    """Events by hour, every half hour."""
    x = windows.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value")
    return x.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, run")
def x_sessions(spark: S, d: str) -> D:
    """Events of a user without a pause of half an hour."""
    x = windows.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], "value")
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"SELECT event_type, {_W} AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_stream_tumbling(spark: S, d: str) -> D:
    """Events by hour, from a stream run to its end."""
    e = windows.file_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = windows.drain(spark, windows.tumbling(e, "ts", "1 hour", ["event_type"], "value", late="10 minutes"))
    return x.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def x_stream_dedup(spark: S, d: str) -> D:
    """Distinct events of a stream."""
    e = windows.file_stream(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return windows.drain(spark, windows.deduplicated(e, "ts", ["event_id"], "400 days"), "append").select("event_id", "user_id")


@query("WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS run FROM events) SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM g GROUP BY user_id, event_type, run")
def x_stream_runs(spark: S, d: str) -> D:
    """Runs of one event type per user, from state kept by user, those still open at the end too."""
    x = windows.drained_runs(spark, windows.file_stream(spark, d, "events"), "user_id", "ts", F.col("event_type"))
    return x.select("key", "value", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, run")
def x_stream_sessions(spark: S, d: str) -> D:
    """Sessions of users, from a stream run to its end."""
    e = windows.file_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = windows.drain(spark, windows.sessions(e, "ts", "30 minutes", ["user_id"], "value"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"WITH {SEG} SELECT a.recording, a.idx, count(*) AS longer FROM seg a JOIN seg b ON a.recording = b.recording AND b.duration > a.duration AND b.words < a.words GROUP BY 1, 2")
def x_theta(spark: S, d: str) -> D:
    """Segments of the same recording that are longer and have fewer words: a join by inequalities."""
    a = segments(spark, d).select("recording", "idx", "duration", "words")
    b = a.select("recording", F.col("duration").alias("d"), F.col("words").alias("w"))
    return rel.theta_join(a, b, ["recording"], (F.col("d") > F.col("duration")) & (F.col("w") < F.col("words"))).groupBy("recording", "idx").agg(F.count("*").alias("longer"))


@query(f"WITH {SEG} SELECT recording, idx, nth_value(words, 2) OVER w AS second, lag(words, 2, -1) OVER w AS before, percent_rank() OVER w AS share, cume_dist() OVER w AS upto FROM seg WINDOW w AS (PARTITION BY recording ORDER BY idx)")
def x_nth_value(spark: S, d: str) -> D:
    """The second value so far, offsets with a default, relative ranks."""
    w = Window.partitionBy("recording").orderBy("idx")
    return segments(spark, d).select("recording", "idx", F.nth_value("words", 2).over(w).alias("second"), F.lag("words", 2, -1).over(w).alias("before"), F.percent_rank().over(w).alias("share"), F.cume_dist().over(w).alias("upto"))


@query("SELECT event_type, count(DISTINCT user_id) > 0 AS some, true AS users_near, true AS median_near, count(*) AS n FROM events GROUP BY event_type")
def x_merged_sketches(spark: S, d: str) -> D:
    """Distinct users and medians from sketches made a day at a time and merged, compared with the exact figures."""
    e = table(spark, d, "events")
    days = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", 12).alias("users"), F.kll_sketch_agg_double("value").alias("values"), F.count("*").alias("n"))
    x = days.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_double("values").alias("values"), F.sum("n").alias("n"))
    exact = e.groupBy(F.col("event_type").alias("t")).agg(F.count_distinct("user_id").alias("true"), F.percentile("value", F.array(F.lit(0.45), F.lit(0.55))).alias("band"))
    x = x.join(exact, F.col("event_type") == F.col("t")).withColumn("median", F.kll_sketch_get_quantile_double("values", F.lit(0.5)))
    return x.select("event_type", (F.col("users") > 0).alias("some"), (F.abs(F.col("users") - F.col("true")) <= 0.1 * F.col("true") + 1).alias("users_near"), F.col("median").between(F.col("band")[0], F.col("band")[1]).alias("median_near"), "n")


@query("SELECT doc_id, lang, source, recording FROM documents")
def x_orc(spark: S, d: str) -> D:
    """A table through ORC and back."""
    path = fresh_path(spark, "orc")
    table(spark, d, "documents").select("doc_id", "lang", "source", "recording").write.orc(path)
    return spark.read.orc(path)


@query("SELECT doc_id, lang, source, recording FROM documents")
def x_json(spark: S, d: str) -> D:
    """A table through JSON lines and back, with a declared schema."""
    path = fresh_path(spark, "json")
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "recording")
    x.write.json(path)
    return spark.read.schema(x.schema).json(path)
