"""Cleaned views of the corpus tables that many queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.plans.registry import table

MEASURES = {
    "duration": "duration__segments",
    "coverage": "recognized_sound_coverage__segments",
    "missed_words": "missed_words_percentage__segments",
    "missed_chars": "missed_chars_percentage__segments",
    "char_duration": "avg_char_duration__segments",
    "word_dist": "avg_norm_word_dist__segments",
    "dist80": "char_norm_word_dist_80__segments",
    "gap_dist": "avg_norm_word_dist_with_gaps__segments",
}
COUNTS = {"words": "words_cnt__segments", "chars": "chars_cnt__segments", "speakers": "speakers_cnt__segments"}


def recording(df: DataFrame | None = None) -> Column:
    ids = [F.regexp_extract(c, r"\d{16}", 0) for c in ("mp3_name", "path", "segment_path")]
    return F.coalesce(*(F.when(i != "", i) for i in ids))


def good(c: str) -> Column:
    return F.when((F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double")), F.col(c))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a recording and index: type, measures and counts, impossible values null."""
    kind = F.translate(F.regexp_replace(F.lower(F.trim("type")), "^asr-", ""), "-.", "__")
    s = table(spark, sf_dir, "split_filelist").withColumn("recording", recording()).withColumn("kind", F.coalesce(F.nullif(kind, F.lit("")), F.lit("other")))
    keys = [F.col("recording"), F.col("segment_index__segments").cast("long").alias("idx")]
    return s.groupBy(*keys).agg(
        F.min("kind").alias("type"),
        *(F.min(good(c)).alias(n) for n, c in MEASURES.items()),
        *(F.coalesce(F.min(good(c)), F.lit(0)).cast("long").alias(n) for n, c in COUNTS.items()),
    )


_g = lambda c: f"min(CASE WHEN {c} >= 0 AND NOT isnan(CAST({c} AS DOUBLE)) THEN {c} END)"
SEG = (
    "seg AS (SELECT coalesce(nullif(regexp_extract(mp3_name, '[0-9]{16}'), ''), nullif(regexp_extract(path, '[0-9]{16}'), ''), nullif(regexp_extract(segment_path, '[0-9]{16}'), '')) AS recording, "
    "CAST(segment_index__segments AS BIGINT) AS idx, min(coalesce(nullif(replace(replace(regexp_replace(lower(trim(type)), '^asr-', ''), '-', '_'), '.', '_'), ''), 'other')) AS type, "
    + ", ".join(f"{_g(c)} AS {n}" for n, c in MEASURES.items())
    + ", "
    + ", ".join(f"CAST(coalesce({_g(c)}, 0) AS BIGINT) AS {n}" for n, c in COUNTS.items())
    + " FROM split_filelist GROUP BY 1, 2)"
)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of ``words`` that have an id."""
    return table(spark, sf_dir, "words").where("word_id is not null").distinct()


WORDS = "wrd AS (SELECT DISTINCT * FROM words WHERE word_id IS NOT NULL)"


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of ``aligned_words`` that have an id."""
    return table(spark, sf_dir, "aligned_words").where("id is not null").distinct()


ALIGNED = "ali AS (SELECT DISTINCT * FROM aligned_words WHERE id IS NOT NULL)"
