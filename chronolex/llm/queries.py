"""The pN_ queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.llm import clusters, held
from chronolex.llm.tables import frame_of, recording_in, segment_of, table
from chronolex.shared import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- 4: held sounds

_LATEST = """latest AS (
  SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS segm, CAST(split_part(path, '/', 3) AS BIGINT) AS frame, km100
  FROM cluster_labels
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY loaded_at DESC NULLS LAST, km100 DESC NULLS LAST) = 1)"""
_HELD = f"""WITH {_LATEST}, cuts AS (
  SELECT segm, frame, km100, CASE WHEN frame - lag(frame) OVER (PARTITION BY segm, km100 ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS cut
  FROM latest WHERE km100 IS NOT NULL), runs AS (
  SELECT segm, frame, km100, sum(cut) OVER (PARTITION BY segm, km100 ORDER BY frame) AS run FROM cuts)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cluster_labels").select(segment_of(F.col("path")).alias("segm"), frame_of(F.col("path")).alias("frame"), "km100", "loaded_at")


def _held(spark: SparkSession, sf_dir: str, min_length: int) -> DataFrame:
    return held.held_runs(
        _frames(spark, sf_dir), key=F.col("segm"), position=F.col("frame"), label=F.col("km100"), version=F.col("loaded_at"), max_slip=2, min_length=min_length, rate=50.0
    )


@query(_HELD + """ SELECT segm, CAST(min(frame) AS INT) AS first_frame, CAST(max(frame) AS INT) AS last_frame FROM runs
  GROUP BY segm, km100, run HAVING max(frame) - min(frame) + 1 >= 25""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held sounds of 25 frames or more."""
    x = _held(spark, sf_dir, 25)
    return x.select(F.col("key").alias("segm"), F.col("first").cast("int").alias("first_frame"), F.col("last").cast("int").alias("last_frame"))


@query(_HELD + """ SELECT segm, km100, min(frame) AS first_frame, max(frame) - min(frame) + 1 AS frames, count(*) AS labelled, (max(frame) - min(frame) + 1) / 50.0 AS seconds
  FROM runs GROUP BY segm, km100, run""")
def p4_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held sound with first frame, number of frames and duration."""
    x = _held(spark, sf_dir, 1)
    return x.select(F.col("key").alias("segm"), F.col("label").alias("km100"), F.col("first").alias("first_frame"), F.col("length").alias("frames"), F.col("events").alias("labelled"), "seconds")


# ---------------------------------------------------------------- 6: renderings of one take


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _frames(spark, sf_dir)
    return materialise(clusters.label_sequences(x, key=F.col("segm"), position=F.col("frame"), label=F.col("km100"), version=F.col("loaded_at")), "sequences")


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments that are renderings of one take: the similar pairs inside the density clusters."""
    pairs = clusters.pairs_in_clusters(_sequences(spark, sf_dir))
    return pairs.select(F.col("a").alias("segm_a"), F.col("b").alias("segm_b"))


@query()
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups with size and most typical members."""
    return clusters.describe_clusters(clusters.density_clusters(_sequences(spark, sf_dir)))


# ---------------------------------------------------------------- 2: percentiles


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, recording, x): each row once, values finite and not negative."""
    w = table(spark, sf_dir, "words")
    a = table(spark, sf_dir, "aligned_words")
    s = table(spark, sf_dir, "split_filelist")
    rows = [
        w.select(F.lit("avg_char_duration").alias("field_name"), F.substring_index("segm", "/", 1).alias("recording"), F.col("avg_char_duration").alias("x"), F.xxhash64(*w.columns).alias("row")),
        a.select(F.lit("dist_norm"), F.col("recording"), F.col("dist_norm"), F.xxhash64(*a.columns)),
    ]
    s = s.select(recording_in(F.col("mp3_name"), F.col("path"), F.col("segment_path")).alias("recording"), F.col("segment_index__segments").cast("long").alias("row"), F.col("duration__segments").alias("x"), "loaded_at")
    s = s.groupBy("recording", "row").agg(F.max_by("x", F.struct("loaded_at", "x")).alias("x"))
    rows.append(s.select(F.lit("duration__segments"), "recording", "x", "row"))
    x = rows[0].unionByName(rows[1].toDF(*rows[0].columns)).where("x >= 0 and not isnan(x) and x < double('infinity')").distinct()
    return x.select("field_name", "recording", "x").unionByName(rows[2].toDF("field_name", "recording", "x", "row").where("x >= 0 and not isnan(x) and x < double('infinity')").select("field_name", "recording", "x"))


_FIELDS = {"avg_char_duration": (0.9, 0.16, 40), "dist_norm": (0.5, 0.35, 40), "duration__segments": (0.5, 20.0, 20)}


def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm import quantiles

    x = _measures(spark, sf_dir)
    return quantiles.grouped_percentiles(x, {"field_name": F.col("field_name"), "recording": F.col("recording")}, F.col("x"), [0.5, 0.75, 0.9, 0.99])


_P2 = """WITH w AS (SELECT DISTINCT * FROM words), a AS (SELECT DISTINCT * FROM aligned_words), s AS (
  SELECT DISTINCT regexp_extract(coalesce(nullif(regexp_extract(mp3_name, '[0-9]{16}'), ''), path, segment_path), '[0-9]{16}') AS recording, segment_index__segments, duration__segments FROM split_filelist),
x AS (SELECT 'avg_char_duration' AS field_name, split_part(segm, '/', 1) AS recording, avg_char_duration AS x, 0.9 AS q, 0.16 AS lim, 40 AS least FROM w
  UNION ALL SELECT 'dist_norm', recording, dist_norm, 0.5, 0.35, 40 FROM a
  UNION ALL SELECT 'duration__segments', recording, duration__segments, 0.5, 20.0, 20 FROM s)
"""


@query(_P2 + """SELECT field_name, recording FROM x WHERE x >= 0 AND NOT isnan(x) AND NOT isinf(x) GROUP BY field_name, recording
  HAVING count(*) >= any_value(least) AND (CASE WHEN field_name = 'avg_char_duration' THEN quantile_cont(x, 0.9) ELSE quantile_cont(x, 0.5) END) > any_value(lim)""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose percentile lies above the limit."""
    x = _percentiles(spark, sf_dir)
    at = {0.5: 0, 0.9: 2}
    keep = F.lit(False)
    for field, (share, limit, least) in _FIELDS.items():
        keep = keep | ((F.col("field_name") == field) & (F.col("n") >= least) & (F.col("percentiles")[at[share]]["value"] > limit))
    return x.where(keep).select("field_name", "recording")


@query()
def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and other percentiles of the three measures, with the rank error of each."""
    x = _percentiles(spark, sf_dir)
    return x.select("field_name", "recording", "n", F.explode("percentiles").alias("p")).select("field_name", "recording", "n", "p.share", "p.value", "p.error")


# ---------------------------------------------------------------- 3: splits


MOST_SIDES = 100


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.splits import split_related

    s = table(spark, sf_dir, "split_filelist").select("mp3_name", "path", "segment_path", "segment_index__segments", "type").distinct()
    spelt = F.nullif(F.lower(F.trim("mp3_name")), F.lit(""))
    entities = [F.concat(F.lit("recording:"), recording_in(F.col(c))) for c in ("mp3_name", "path", "segment_path")] + [F.concat(F.lit("name:"), spelt)]
    targets = [tuple(r) for r in table(spark, sf_dir, "split_targets").select("side", "target_share").limit(MOST_SIDES + 1).collect()]
    if len(targets) > MOST_SIDES:
        raise ValueError(f"more than {MOST_SIDES} sides have a target")
    return split_related(s, entities, targets).withColumn("recording", recording_in(F.col("mp3_name"), F.col("path"), F.col("segment_path")))


@query("""WITH x AS (SELECT regexp_extract(coalesce(nullif(regexp_extract(mp3_name, '[0-9]{16}'), ''), path, segment_path), '[0-9]{16}') AS recording,
    regexp_extract(lower(trim(type)), '(train|dev|test)$') AS side FROM split_filelist)
  SELECT recording FROM x WHERE side <> '' AND recording <> '' GROUP BY recording HAVING count(DISTINCT side) >= 2""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that stand on two or three of the sides today."""
    x = _split(spark, sf_dir)
    now = F.nullif(F.regexp_extract(F.lower(F.trim("type")), "(train|dev|test)$", 1), F.lit(""))
    x = x.select("component", "recording", now.alias("now")).where("now is not null and recording is not null")
    bits = F.bit_or(F.expr("case now when 'train' then 1 when 'dev' then 2 else 4 end"))
    return x.groupBy("component", "recording").agg(bits.alias("sides")).where("bit_count(sides) >= 2").select("recording")


@query()
def p3_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and recordings of each new side, with the share of segments it got."""
    x = _split(spark, sf_dir).select("recording", "segment_index__segments", "component", "side").distinct()
    x = x.groupBy("side", "component").agg(F.count("*").alias("n")).groupBy("side").agg(F.sum("n").alias("segments"), F.count("component").alias("components"))
    x = x.withColumn("total", F.sum("segments").over(Window.partitionBy(F.lit(1))))  # three rows
    t = table(spark, sf_dir, "split_targets").select(F.col("side").alias("s"), "target_share")
    x = x.join(t, F.col("s") == F.col("side"))
    return x.select("side", "segments", "components", "target_share", (F.col("segments") / F.col("total")).alias("share"))


# ---------------------------------------------------------------- 10: repetition


REPEATED = 0.35


def _repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.repetition import repetition

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition(docs, key=F.col("doc_id"), text=F.col("text"), max_boilerplate=REPEATED).withColumnRenamed("key", "doc_id")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
f AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS five FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, CASE WHEN five IS NOT NULL AND i > min(i) OVER (PARTITION BY doc_id, five) THEN 1 ELSE 0 END AS again FROM f),
m AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS said FROM r)
SELECT doc_id FROM m GROUP BY doc_id HAVING avg(said) >= 0.35""")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents the field does not keep, their content share being too low; the exact share is checked last.

    No line with a repeated stretch is content, so the check can only take documents away.
    """
    x = _repetition(spark, sf_dir).where("not keep")
    return x.where(f"repeated_share >= {REPEATED}").select("doc_id").distinct()


@query()
def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of repeated and of content words for every document."""
    return _repetition(spark, sf_dir)


# ---------------------------------------------------------------- 7: speaker turns


def _spoken(spark: SparkSession, sf_dir: str, what) -> DataFrame:
    return what(
        table(spark, sf_dir, "words"), table(spark, sf_dir, "speakers"), segment=F.col("segm"), word=F.col("word"), speaker=F.col("speaker"),
        start=F.col("start_time"), end=F.col("end_time"), tie=F.col("word_id"), transcript=F.substring_index("segm", "/", 1),
    )


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns with the start of their first word."""
    from chronolex.llm.turns import turn_starts

    x = _spoken(spark, sf_dir, turn_starts)
    return x.select("segm", "speaker_id", F.round(F.col("start") * 1000).cast("long").alias("start_ms"))


@query()
def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns in order with their clean text."""
    from chronolex.llm.turns import spoken_words, turns

    return turns(_spoken(spark, sf_dir, spoken_words)).select("segm", "turn", "speaker_id", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), "words", "text")


# ---------------------------------------------------------------- 8: containers

CONTAINER = 4096


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.tokens import token_count

    docs = table(spark, sf_dir, "documents")
    return materialise(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")), "tokens")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.packing import pack

    return pack(_sized(spark, sf_dir), key=F.col("doc_id"), size=F.col("tokens"), capacity=CONTAINER).withColumnRenamed("key", "doc_id")


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than one container: those the packing had to split."""
    return _packed(spark, sf_dir).where("piece > 0").select("doc_id").distinct()


@query()
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout: every document or piece with its container."""
    return _packed(spark, sf_dir)


@query()
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least that could do, and the share of space filled."""
    x = _packed(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum("size").alias("size"))
    x = x.agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"))
    return x.withColumn("least", F.ceil(F.col("tokens") / CONTAINER)).withColumn("filled", F.col("tokens") / (F.col("containers") * CONTAINER))


# ---------------------------------------------------------------- 9: mixing


def _mixed(spark: SparkSession, sf_dir: str):
    from chronolex.llm.mixing import mix

    return mix(_sized(spark, sf_dir), key=F.col("doc_id"), source=F.col("source"), size=F.col("tokens"), targets=table(spark, sf_dir, "mix_targets"))


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fall short of their target even when repeated as often as allowed."""
    short = _mixed(spark, sf_dir).report.where("short").select(F.col("source").alias("s"))
    t = table(spark, sf_dir, "mix_targets").select("source").distinct()
    return t.join(short, F.lower(F.trim("source")) == F.col("s")).select("source")


@query()
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual share of every source with a target."""
    return _mixed(spark, sf_dir).report


@query()
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: documents with slot and repetition."""
    return _mixed(spark, sf_dir).records
