"""Queries of sources, projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import text as T
from chronolex.operators import filters as fl
from chronolex.operators import relational as rel
from chronolex.operators import stats
from chronolex.plans.base import SEG, WORDS, segments, words
from chronolex.plans.registry import query, table

S = SparkSession
D = DataFrame


@query("SELECT file_id, coalesce(segm, '-') AS segm, n_bytes FROM segment_files")
def null_token(spark: S, d: str) -> D:
    """A null token in place of nulls."""
    return table(spark, d, "segment_files").select("file_id", "segm", "n_bytes").fillna({"segm": "-"})


@query(f"""WITH {WORDS}, r AS (SELECT id, any_value(recognized) AS recognized, min(start) AS start FROM aligned_words WHERE id IS NOT NULL GROUP BY id)
SELECT word_id, coalesce(start / 1000.0, start_time) AS start_s FROM wrd LEFT JOIN r ON id = word_id""")
def coalesce_source(spark: S, d: str) -> D:
    """The aligned start where there is one, else the transcript's."""
    a = table(spark, d, "aligned_words").where("id is not null").groupBy("id").agg(F.min("start").alias("start"))
    return words(spark, d).join(a, F.col("id") == F.col("word_id"), "left").select("word_id", F.coalesce(F.col("start") / 1000.0, "start_time").alias("start_s"))


@query("""SELECT name, speakers__segments AS speakers FROM split_filelist""")
def parse_list(spark: S, d: str) -> D:
    """A list literal in text form back to an array."""
    literal = F.concat(F.lit("['"), F.array_join("speakers__segments", "', '"), F.lit("']"))
    text = F.when(F.size("speakers__segments") == 0, F.lit("[]")).otherwise(literal)
    return table(spark, d, "split_filelist").select("name", F.from_json(F.translate(text, "'", '"'), "array<string>").alias("speakers"))


def _bounded(*bounds):
    def run(spark: S, d: str) -> D:
        return fl.apply_filters(segments(spark, d), bounds).select("recording", "idx", "coverage", "duration")

    return run


@query(f"WITH {SEG} SELECT recording, idx, coverage, duration FROM seg WHERE coverage >= 0.8")
def filter_lb(spark: S, d: str) -> D:
    """Inclusive lower bound."""
    return _bounded(fl.at_least("coverage", 0.8))(spark, d)


@query(f"WITH {SEG} SELECT recording, idx, coverage, duration FROM seg WHERE duration <= 8.0")
def filter_ub(spark: S, d: str) -> D:
    """Inclusive upper bound."""
    return _bounded(fl.at_most("duration", 8.0))(spark, d)


@query(f"WITH {SEG} SELECT recording, idx, coverage, duration FROM seg WHERE coverage >= 0.5 AND coverage <= 1.0 AND duration >= 1 AND duration <= 20")
def filter_chain(spark: S, d: str) -> D:
    """A list of bounds as one conjunction."""
    return _bounded(fl.at_least("coverage", 0.5), fl.at_most("coverage", 1.0), fl.at_least("duration", 1), fl.at_most("duration", 20))(spark, d)


@query(f"WITH {SEG} SELECT recording, idx, type, coverage FROM seg WHERE type IN ('train', 'other') AND coverage > 0.45 AND coverage < 0.98 AND duration > 0.3 AND duration < 30")
def clean_strict(spark: S, d: str) -> D:
    """Strict bounds and the two types training admits."""
    x = segments(spark, d).where(F.col("type").isin("train", "other"))
    return fl.apply_filters(x, [*fl.inside("coverage", 0.45, 0.98), *fl.inside("duration", 0.3, 30)]).select("recording", "idx", "type", "coverage")


@query(f"""WITH {SEG} SELECT recording, idx FROM seg WHERE missed_words <= 0.3 AND missed_chars <= 0.3 AND coverage >= 0.5 AND coverage < 1.02 AND char_duration > 0.03
AND char_duration <= 0.2 AND word_dist <= 0.3 AND dist80 < 0.5 AND gap_dist <= 0.4 AND duration >= 1 AND duration < 40 AND words > 2 AND chars >= 10 AND speakers <= 2""")
def quality_filter(spark: S, d: str) -> D:
    """Fourteen bounds of mixed strictness in one filter."""
    b = [
        fl.at_most("missed_words", 0.3), fl.at_most("missed_chars", 0.3), fl.at_least("coverage", 0.5), fl.Bound("coverage", 1.02, upper=True, strict=True),
        fl.Bound("char_duration", 0.03, strict=True), fl.at_most("char_duration", 0.2), fl.at_most("word_dist", 0.3), fl.Bound("dist80", 0.5, upper=True, strict=True),
        fl.at_most("gap_dist", 0.4), fl.at_least("duration", 1), fl.Bound("duration", 40, upper=True, strict=True), fl.Bound("words", 2, strict=True), fl.at_least("chars", 10), fl.at_most("speakers", 2),
    ]
    return fl.apply_filters(segments(spark, d), b).select("recording", "idx")


_finite = lambda b: f"(CASE WHEN NOT isnan({b.name}) THEN {b.name} END {'<' if b.upper else '>'}{'' if b.strict else '='} {b.value})"


@query("SELECT DISTINCT path, segment_index__segments AS idx FROM split_filelist WHERE " + " AND ".join(_finite(b) for b in fl.QUALITY))
def quality_preset(spark: S, d: str) -> D:
    """The default quality bounds, fourteen over thirteen columns, in one filter on the scan."""
    return fl.apply_filters(table(spark, d, "split_filelist"), fl.QUALITY).select("path", F.col("segment_index__segments").alias("idx")).distinct()


@query("SELECT DISTINCT path, segment_index__segments AS idx FROM split_filelist WHERE " + " AND ".join(_finite(b) for b in fl.quality_bounds(median_norm_word_dist__segments=0.2, char_norm_word_dist_with_gaps_60__segments=0.4, missed_chars_percentage__segments=0.3, missed_words_percentage__segments=0.3)))
def quality_preset_wider(spark: S, d: str) -> D:
    """The same bounds, some of them wider."""
    bounds = fl.quality_bounds(median_norm_word_dist__segments=0.2, char_norm_word_dist_with_gaps_60__segments=0.4, missed_chars_percentage__segments=0.3, missed_words_percentage__segments=0.3)
    return fl.apply_filters(table(spark, d, "split_filelist"), bounds).select("path", F.col("segment_index__segments").alias("idx")).distinct()


@query(f"WITH {SEG} SELECT CASE WHEN type LIKE '%\\_dev' ESCAPE '\\' THEN 'dev' WHEN type LIKE '%\\_test' ESCAPE '\\' THEN 'test' ELSE type END AS split, count(*) AS n FROM seg GROUP BY 1")
def split_types(spark: S, d: str) -> D:
    """Split names grouped to train, dev, test and other."""
    split = F.when(F.col("type").endswith("_dev"), "dev").when(F.col("type").endswith("_test"), "test").otherwise(F.col("type"))
    return segments(spark, d).groupBy(split.alias("split")).agg(F.count("*").alias("n"))


_TESTED = "SELECT DISTINCT recording FROM seg WHERE type LIKE '%test'"


def _tested(spark: S, d: str, negate: bool) -> D:
    x = segments(spark, d)
    return fl.member(x, x.where(F.col("type").endswith("test")), ["recording"], negate).select("recording", "idx", "type")


@query(f"WITH {SEG} SELECT recording, idx, type FROM seg WHERE recording IN ({_TESTED})")
def semi_in(spark: S, d: str) -> D:
    """Segments of recordings that have a test segment."""
    return _tested(spark, d, False)


@query(f"WITH {SEG} SELECT recording, idx, type FROM seg WHERE NOT EXISTS (SELECT 1 FROM seg t WHERE t.recording = seg.recording AND t.type LIKE '%test')")
def anti_in(spark: S, d: str) -> D:
    """Segments of the other recordings; a null key stays."""
    return _tested(spark, d, True)


@query(f"WITH {SEG} SELECT recording, idx FROM seg WHERE idx BETWEEN 3 AND 9")
def between_filter(spark: S, d: str) -> D:
    """Closed range of an index."""
    return segments(spark, d).where(F.col("idx").between(3, 9)).select("recording", "idx")


_PCT = f"WITH {SEG}, pct AS (SELECT recording, idx, char_duration, (row_number() OVER (ORDER BY char_duration, recording, idx) - 1) / CAST(count(*) OVER () AS DOUBLE) AS pct FROM seg WHERE char_duration IS NOT NULL)"


def _pct(spark: S, d: str) -> D:
    return stats.empirical_percentile(segments(spark, d).select("recording", "idx", "char_duration"), "char_duration", ["recording", "idx"])


@query(_PCT + " SELECT recording, idx, pct FROM pct")
def empirical_percentile(spark: S, d: str) -> D:
    """Rank over number of rows."""
    return _pct(spark, d).select("recording", "idx", "pct")


@query(_PCT + " SELECT recording, idx, CASE WHEN pct * 100 <= 90 THEN 'accepted' ELSE 'rejected' END AS band FROM pct WHERE pct * 100 > 85 AND pct * 100 <= 95")
def percentile_bands(spark: S, d: str) -> D:
    """Rows just below and just above the 90th percentile."""
    return stats.percentile_bands(_pct(spark, d), "pct", 90, 5).select("recording", "idx", "band")


@query(_PCT + " SELECT round(avg(char_duration), 6) AS threshold FROM pct WHERE abs(pct - 0.9) < 0.01")
def percentile_threshold(spark: S, d: str) -> D:
    """Mean of the measure around the 90th percentile."""
    return stats.percentile_threshold(_pct(spark, d), "pct", "char_duration", 90, 0.01).select(F.round("threshold", 6).alias("threshold"))


@query(f"WITH {WORDS} SELECT word_id, word FROM wrd WHERE NOT (regexp_matches(word, '^ro') OR regexp_matches(word, 'ová$') OR regexp_matches(word, '[0-9]') OR regexp_matches(word, '^na\\s') OR regexp_matches(word, '^[§(]'))")
def regex_exclude(spark: S, d: str) -> D:
    """Rows in which no unwanted pattern is found."""
    return words(spark, d).where(fl.excluded_by(F.col("word"), [r"^ro", r"ová$", r"[0-9]", r"^na\s", r"^[§(]"])).select("word_id", "word")


@query("SELECT segm, word, start_time, end_time FROM words WHERE start_time IS NOT NULL AND end_time IS NOT NULL")
def drop_nulls(spark: S, d: str) -> D:
    """Rows with all of some columns."""
    return table(spark, d, "words").dropna(subset=["start_time", "end_time"]).select("segm", "word", "start_time", "end_time")


@query("SELECT file_id, segm AS segment, written_at AS at FROM segment_files")
def project_rename(spark: S, d: str) -> D:
    """Selection and renaming."""
    return table(spark, d, "segment_files").select("file_id", "segm", "written_at").withColumnsRenamed({"segm": "segment", "written_at": "at"})


@query(f"WITH {SEG} SELECT recording, idx, 'segment' AS unit, round(duration * 1000, 3) AS ms, chars / greatest(words, 1) AS word_length FROM seg")
def derive_cols(spark: S, d: str) -> D:
    """Constant and computed columns."""
    return segments(spark, d).select("recording", "idx", F.lit("segment").alias("unit"), F.round(F.col("duration") * 1000, 3).alias("ms"), (F.col("chars") / F.greatest("words", F.lit(1))).alias("word_length"))


_ROLE = "(VALUES ('train', 'asr-train'), ('other', 'asr-other'), ('context_dev', 'asr-context.dev'), ('context_test', 'asr-context.test')) AS m(k, v)"


def _folders(spark: S) -> D:
    return spark.createDataFrame([("train", "asr-train"), ("other", "asr-other"), ("context_dev", "asr-context.dev"), ("context_test", "asr-context.test")], "k string, v string")


@query(f"WITH {SEG} SELECT recording, idx, v AS folder FROM seg LEFT JOIN {_ROLE} ON type = k")
def map_missing_null(spark: S, d: str) -> D:
    """Dictionary lookup, null where the key is missing."""
    return _lookup(spark, d, False)


@query(f"WITH {SEG} SELECT recording, idx, coalesce(v, type) AS folder FROM seg LEFT JOIN {_ROLE} ON type = k")
def replace_keep(spark: S, d: str) -> D:
    """Dictionary lookup, the key itself where it is missing."""
    return _lookup(spark, d, True)


def _lookup(spark: S, d: str, keep: bool) -> D:
    pairs = _folders(spark).toDF("type", "v")
    return rel.lookup(segments(spark, d), pairs, "type", "v", "folder", keep).select("recording", "idx", "folder")


@query(f"WITH {SEG} SELECT recording, idx, duration FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY idx) AS rn FROM seg) WHERE rn = 3")
def row_at(spark: S, d: str) -> D:
    """The third row of each recording in order."""
    w = Window.partitionBy("recording").orderBy("idx")
    return segments(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 3").select("recording", "idx", "duration")


@query(f"WITH {SEG} SELECT recording, idx, duration FROM seg ORDER BY duration DESC NULLS LAST, recording, idx LIMIT 10")
def head_n(spark: S, d: str) -> D:
    """The ten longest segments."""
    return segments(spark, d).orderBy(F.desc_nulls_last("duration"), "recording", "idx").limit(10).select("recording", "idx", "duration")


@query("SELECT path, TRY_CAST(split_part(path, '/', 3) AS BIGINT) AS frame, CAST(km5 AS DOUBLE) AS km5, CAST(km100 AS VARCHAR) AS km100 FROM cluster_labels")
def cast_cols(spark: S, d: str) -> D:
    """Casts that give null instead of failing."""
    return table(spark, d, "cluster_labels").select("path", T.piece(F.col("path"), 3).try_cast("long").alias("frame"), F.col("km5").cast("double").alias("km5"), F.col("km100").cast("string").alias("km100"))


_AUDITED = ["segm", "word", "word_id", "start_time", "end_time", "avg_char_duration", "speaker"]
_bad = lambda c, t: f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL OR " + (f"isnan({c})" if t else f"trim({c}) IN ('', 'None', 'NULL', 'null', 'NaN')") + ") AS bad FROM words"
_AUDIT = " UNION ALL ".join(_bad(c, c in ("start_time", "end_time", "avg_char_duration")) for c in _AUDITED)


@query(_AUDIT)
def null_audit(spark: S, d: str) -> D:
    """Nulls, NaNs and their spellings per column in one pass."""
    return fl.null_audit(table(spark, d, "words").select(*_AUDITED))


@query(f"SELECT CAST(sum(bad) AS BIGINT) AS bad FROM ({_AUDIT})")
def null_audit_total(spark: S, d: str) -> D:
    """All of them in one number."""
    return fl.null_total(table(spark, d, "words").select(*_AUDITED))


_TAG = "'pos=' || CASE WHEN recognized THEN 'C' ELSE 'V' END || '|cas=' || CAST(length(true_w) % 8 AS VARCHAR)"


@query(f"SELECT id, recording, split_part(split_part(tag, '|', 2), '=', 2) AS cas FROM (SELECT id, recording, {_TAG} AS tag FROM aligned_words) WHERE tag LIKE 'pos=C|%' AND tag NOT LIKE '%cas=0'")
def tag_parse_filter(spark: S, d: str) -> D:
    """A key=value tag parsed and filtered."""
    tag = F.concat(F.lit("pos="), F.when(F.col("recognized"), "C").otherwise("V"), F.lit("|cas="), F.pmod(F.length("true_w"), F.lit(8)).cast("string"))
    x = table(spark, d, "aligned_words").select("id", "recording", T.tag_map(tag).alias("t"))
    return x.where((F.col("t")["pos"] == "C") & (F.col("t")["cas"] != "0")).select("id", "recording", F.col("t")["cas"].alias("cas"))


@query(f"WITH {SEG} SELECT type, min(recording) AS seen FROM seg GROUP BY type")
def distinct_values(spark: S, d: str) -> D:
    """Distinct values with their first appearance."""
    return segments(spark, d).groupBy("type").agg(F.min("recording").alias("seen"))


@query("""SELECT path, split_part(path, '/', 1) AS recording, split_part(path, '/', 2) AS segment, split_part(path, '/', -1) AS frame, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS segm FROM cluster_labels""")
def path_parts(spark: S, d: str) -> D:
    """Pieces of a path from both ends."""
    p = F.col("path")
    return table(spark, d, "cluster_labels").select("path", T.piece(p, 1).alias("recording"), T.piece(p, 2).alias("segment"), T.piece(p, -1).alias("frame"), F.array_join(F.slice(T.parts(p), 1, 2), "/").alias("segm"))

