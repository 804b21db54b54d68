"""Queries of file sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.plans.base import WORDS, segments, words
from chronolex.plans.registry import query, table
from chronolex.shared import fresh_path
from chronolex.sources import delimited

S = SparkSession
D = DataFrame
_COLUMNS = "word_id, word, start_time, end_time, avg_char_duration"
_SCHEMA = "word_id string, word string, start_time double, end_time double, avg_char_duration double"


def _plain(spark: S, d: str) -> D:
    c = _COLUMNS.split(", ")
    number = [F.when(~F.isnan(x), F.col(x)).alias(x) for x in c[2:]]
    return words(spark, d).select(*c[:2], *number)


_SQL = f"WITH {WORDS} SELECT word_id, word, CASE WHEN NOT isnan(start_time) THEN start_time END AS start_time, CASE WHEN NOT isnan(end_time) THEN end_time END AS end_time, CASE WHEN NOT isnan(avg_char_duration) THEN avg_char_duration END AS avg_char_duration FROM wrd"


@query(_SQL)
def scan_delimited(spark: S, d: str) -> D:
    """A table through tab-separated files and back."""
    path = fresh_path(spark, "tsv")
    delimited.write_delimited(_plain(spark, d), path, "\t")
    return delimited.scan(spark, path, _SCHEMA, "\t", only="*.csv")


@query(_SQL.replace("SELECT word_id, word,", "SELECT word_id, '<quote>' || word || '<quote>' AS word,"))
def quote_safe_scan(spark: S, d: str) -> D:
    """Quotation marks in the text as a sentinel."""
    path = fresh_path(spark, "quoted")
    x = _plain(spark, d)
    x.select(F.concat_ws("\t", "word_id", F.concat(F.lit('"'), "word", F.lit('"')), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in x.columns[2:])).alias("value")).write.text(path)
    return delimited.quote_safe_scan(spark, path, _SCHEMA)


@query(_SQL)
def scan_validated(spark: S, d: str) -> D:
    """Files with all columns; a file that lacks some is left out."""
    path = fresh_path(spark, "valid")
    delimited.write_delimited(_plain(spark, d), path)
    _plain(spark, d).select("word_id", "word").limit(5).write.mode("append").option("header", True).csv(path)
    return delimited.scan_validated(spark, path, _SCHEMA)[0]


@query("SELECT DISTINCT path, split_part(path, '/', 1) AS recording FROM cluster_labels")
def bucketed_write(spark: S, d: str) -> D:
    """One folder a bucket, the written keys verified."""
    path = fresh_path(spark, "buckets")
    x = table(spark, d, "cluster_labels").select("path", F.substring_index("path", "/", 1).alias("recording")).distinct()
    delimited.bucketed_write(x.withColumn("bucket", F.pmod(F.xxhash64("recording"), F.lit(8))), path, "bucket", ["path"])
    return spark.read.parquet(path).select("path", "recording")


@query("WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT path FROM cluster_labels)) SELECT true AS fit, n AS rows FROM n")
def write_chunks(spark: S, d: str) -> D:
    """Files of at most a thousand rows, which together hold every row."""
    path = fresh_path(spark, "chunks")
    delimited.write_chunks(table(spark, d, "cluster_labels").select("path").distinct(), path, 1000)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") <= 1000).alias("fit"), F.sum("n").alias("rows"))


@query(_SQL)
def scan_folder(spark: S, d: str) -> D:
    """A folder of many headerless files, other files in it not read."""
    path = fresh_path(spark, "folder")
    _plain(spark, d).repartition(16).write.option("sep", "\t").csv(path)
    spark.range(5).write.mode("append").json(path)
    return delimited.scan(spark, path, _SCHEMA, "\t", header=False, only="*.csv")


@query("SELECT speaker_id, surname FROM speakers")
def scan_texts(spark: S, d: str) -> D:
    """Every file one text: a folder written over by a second table, then read file by file."""
    path = fresh_path(spark, "texts")
    table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.mode("overwrite").text(path)
    x = table(spark, d, "speakers").select("speaker_id", F.concat("surname", F.lit(" \n\n")).alias("value"))
    x.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("speaker_id").text(path)
    return delimited.whole_texts(spark, path, "*.txt").select(F.regexp_extract("path", r"speaker_id=(\d+)", 1).cast("int").alias("speaker_id"), F.col("text").alias("surname"))


@query("WITH w AS (SELECT DISTINCT segment_path AS k FROM split_filelist WHERE segment_path IS NOT NULL), h AS (SELECT segment_path AS k, min(file_path) AS source, count(DISTINCT file_path) AS copies FROM segment_files WHERE segment_path IS NOT NULL GROUP BY 1) SELECT source, '/out/' || w.k AS target, coalesce(copies, 0) AS copies, CASE WHEN source IS NULL THEN 'absent' WHEN copies > 1 THEN 'unclear' ELSE 'copy' END AS state FROM w LEFT JOIN h USING (k)")
def copy_manifest(spark: S, d: str) -> D:
    """Which files to copy where, which are not there, and which are not the only ones."""
    return delimited.copy_manifest(table(spark, d, "split_filelist").select("segment_path"), table(spark, d, "segment_files").select("segment_path", "file_path"), "segment_path", "file_path", "/out")


@query("SELECT event_id, strftime(ts, '%d.%m__%H.%M') AS label, printf('%.3f', value) AS shown FROM events")
def time_label(spark: S, d: str) -> D:
    """Times and values formatted as labels."""
    return table(spark, d, "events").select("event_id", F.date_format("ts", "dd.MM'__'HH.mm").alias("label"), F.format_string("%.3f", "value").alias("shown"))
