"""The general data-preparation queries: small files (1) and time intervals (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import compaction, coverage
from chronolex.plans.registry import query, table
from chronolex.shared import fresh_path

KEY = ["recording", "segment", "frame"]

_RECORDS = r"""WITH named AS (
  SELECT file_id, body, CASE WHEN regexp_matches(segm, '([0-9]{16})[^0-9]+([0-9]+)[^0-9]*$') THEN segm ELSE segment_path END AS name FROM segment_files),
lines AS (SELECT file_id, regexp_extract(name, '([0-9]{16})[^0-9]+[0-9]+[^0-9]*$', 1) AS recording,
    TRY_CAST(regexp_extract(name, '[0-9]{16}[^0-9]+([0-9]+)[^0-9]*$', 1) AS BIGINT) AS segment,
    unnest(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM named),
records AS (SELECT file_id, recording, segment, CAST(regexp_extract(line, '^\s*([0-9]+)', 1) AS BIGINT) AS frame, CAST(regexp_extract(line, '([0-9]+)\s*$', 1) AS INTEGER) AS km100
  FROM lines WHERE recording <> '' AND segment IS NOT NULL AND regexp_matches(line, '^\s*[0-9]+[^0-9A-Za-z][0-9]+\s*$'))"""


def _compacted(spark: SparkSession, sf_dir: str) -> compaction.Compacted:
    records = compaction.parse_label_files(table(spark, sf_dir, "segment_files"))
    return compaction.compact(records, KEY, fresh_path(spark, "labels"), order="file_id")


@query(_RECORDS + """, own AS (SELECT DISTINCT file_id FROM (SELECT min(file_id) AS file_id FROM records GROUP BY recording, segment, frame))
SELECT file_id FROM segment_files WHERE file_id NOT IN (SELECT file_id FROM own)""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that bring no record of their own into the compacted table."""
    own = _compacted(spark, sf_dir).read(spark).select("file_id").distinct()
    return table(spark, sf_dir, "segment_files").select("file_id").join(own, "file_id", "left_anti")


@query(_RECORDS + """ SELECT recording, segment, frame, min(file_id) AS file_id, arg_min(km100, {'f': file_id, 'k': km100}) AS km100 FROM records GROUP BY recording, segment, frame""")
def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted table: every record once."""
    return _compacted(spark, sf_dir).read(spark).select(*KEY, "file_id", "km100")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "words").select(F.lit("words").alias("table_name"), F.col("segm").alias("entity"), _ms(F.col("start_time")).alias("s"), _ms(F.col("end_time")).alias("e"))
    a = table(spark, sf_dir, "aligned_words")
    a = a.select(F.lit("aligned_words"), F.col("recording"), F.when(~F.isnan("start"), F.round("start")).cast("long"), F.when(~F.isnan("end"), F.round("end")).cast("long"))
    x = w.unionByName(a.toDF(*w.columns))
    return x.select(F.concat_ws("\t", "table_name", "entity").alias("entity"), "s", "e").where("entity like '%\t%'")


def _ms(seconds):
    return F.when(~F.isnan(seconds), F.round(seconds * 1000)).cast("long")


def _named(x: DataFrame, first: str, second: str) -> DataFrame:
    name = F.split("entity", "\t", 2)
    return x.select(name[0].alias("table_name"), name[1].alias("entity"), F.col(first).alias(f"{first}_ms"), F.col(second).alias(f"{second}_ms"))


_COVER = """WITH x AS (
  SELECT 'words' AS table_name, segm AS entity, CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e FROM words WHERE NOT isnan(start_time) AND NOT isnan(end_time)
  UNION ALL SELECT 'aligned_words', recording, CAST(round(start) AS BIGINT), CAST(round("end") AS BIGINT) FROM aligned_words WHERE NOT isnan(start) AND NOT isnan("end")),
r AS (SELECT *, max(e) OVER (PARTITION BY table_name, entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x WHERE entity IS NOT NULL AND e >= s)"""


@query(_COVER + " SELECT table_name, entity, reach AS gap_start_ms, s AS gap_end_ms FROM r WHERE s - reach >= 500")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of half a second or more between covered periods."""
    x = coverage.gaps(_intervals(spark, sf_dir), entity=F.col("entity"), start=F.col("s"), end=F.col("e"), min_length=500)
    return _named(x, "gap_start", "gap_end")


@query(_COVER + """, n AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY table_name, entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r)
  SELECT table_name, entity, min(s) AS period_start_ms, max(e) AS period_end_ms FROM n GROUP BY table_name, entity, run""")
def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covered periods themselves."""
    x = coverage.periods(_intervals(spark, sf_dir), entity=F.col("entity"), start=F.col("s"), end=F.col("e"))
    return _named(x, "period_start", "period_end")
