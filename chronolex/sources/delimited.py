"""Delimited and plain text files in, with declared schemas, and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas of the corpus files, columns in file order.
WORDS = "word string, word_id string, start_time double, end_time double, xxx string, avg_char_duration double, speaker string"
ALIGNED = "true_w string, trans_w string, joined boolean, id string, recognized boolean, dist double, dist_norm double, start double, end double, time_len_ms double, time_len_norm double"
RECOGNIZED = "start double, end double, recognized string, true_word string, cnt int, dist double"
LABELS = ", ".join(f"km{k} int" for k in (5, 10, 15, 20, 25, 50, 75, 100, 200, 250, 300, 500)) + ", path string, mp3 string, segm string"
QUOTE = "<quote>"


def scan(spark: SparkSession, path: str | list[str], schema: str | StructType, separator: str = ",", header: bool = True, null: str | None = None, quotes: bool = True, only: str | None = None) -> DataFrame:
    """Delimited files under a path or glob with a declared schema; no pass to guess types.

    ``only`` is a file name pattern such as ``*.csv``: other files in the folder are not read.
    ``quotes`` False takes quotation marks as text. ``null`` is the token of a null.
    """
    r = spark.read.schema(schema).option("sep", separator).option("header", header).option("mode", "PERMISSIVE")
    if null is not None:
        r = r.option("nullValue", null)
    if not quotes:
        r = r.option("quote", "")
    if only:
        r = r.option("pathGlobFilter", only)
    return r.csv(path)


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    """Headerless word files, quotation marks as text."""
    return scan(spark, path, WORDS, "\t", header=False, quotes=False)


def scan_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Aligned words; ``-`` is null, but in ``trans_w`` it stays."""
    return scan(spark, path, ALIGNED, "\t", null="-").fillna({"trans_w": "-"})


def quote_safe_scan(spark: SparkSession, path: str, schema: str, separator: str = "\t", sentinel: str = QUOTE) -> DataFrame:
    """Headerless files in which every quotation mark becomes the sentinel."""
    text = spark.read.text(path).select(F.regexp_replace("value", '"', sentinel).alias("value"))
    return text.select(F.from_csv("value", schema, {"sep": separator}).alias("r")).select("r.*")


def scan_validated(spark: SparkSession, path: str, schema: str, separator: str = ",", only: str = "*.csv", multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the files whose header has all the columns, (file, columns) of the others).

    The first line of each file, one row a file, says which are good; the rows then come from the
    CSV reader, so quotation marks count and a data row that looks like the header stays. ``multiline``
    lets quoted values hold line ends, at the price of one task a file.
    """
    want = len(spark.createDataFrame([], schema).columns)
    lines = spark.read.option("pathGlobFilter", only).text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    heads = heads.select("file", F.size(F.split("head", F.lit(_plain(separator)))).alias("columns"))
    rows = spark.read.schema(schema).option("sep", separator).option("header", True).option("pathGlobFilter", only).option("multiLine", multiline).csv(path)
    names = rows.columns
    rows = rows.withColumn("__file", F.col("_metadata.file_path"))
    good = heads.where(F.col("columns") == want).select(F.col("file").alias("__file"))
    return rows.join(good, "__file", "left_semi").select(*names), heads.where(F.col("columns") != want)


def _plain(separator: str) -> str:
    return separator if separator.isspace() else f"\\{separator}"


def whole_texts(spark: SparkSession, path: str, only: str = "*") -> DataFrame:
    """(path, text): each file as one text without white space at its end."""
    x = spark.read.option("pathGlobFilter", only).text(path, wholetext=True)
    return x.select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\s+$", "").alias("text"))


def first_available(primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the primary source's value, else the fallback's."""
    p, f = (df.select(key, F.col(value).alias(n)) for df, n in ((primary, "__p"), (fallback, "__f")))
    return p.join(f, key, "full").select(key, F.coalesce("__p", "__f").alias(value))


def parse_list(text: Column) -> Column:
    """A list literal with single or double quotes as an array of strings."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    """Files with a header, replacing what is there."""
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_chunks(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def bucketed_write(df: DataFrame, path: str, bucket: str, keys: list[str]) -> dict[str, int]:
    """One folder a bucket in a single pass, then the written keys against the given ones.

    Returns counts of keys only given, only written and in both; a difference raises RuntimeError.
    """
    from chronolex.operators.relational import keys_differ

    df.repartition(bucket).write.mode("overwrite").partitionBy(bucket).parquet(path)
    found = keys_differ(df, df.sparkSession.read.parquet(path), [bucket, *keys]).first().asDict()
    if found["only_left"] or found["only_right"]:
        raise RuntimeError(f"keys given and written differ: {found}")
    return found


def copy_manifest(listed: DataFrame, present: DataFrame, key: str, source: str, root: str) -> DataFrame:
    """(source, target, copies, state): the plan of copying listed files to a folder of their own.

    ``listed`` names the files wanted by ``key``, ``present`` has what is there with its ``source`` path.
    Each file is copied once, to ``root``/key. state: copy, absent (listed, not there), unclear
    (several files of one key); files not listed are in no plan. Null keys are in no list.
    """
    want = listed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__asked"))
    have = present.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(source).alias("source"), F.count_distinct(source).alias("copies"))
    x = want.join(have, key, "left")
    state = F.when(F.col("source").isNull(), "absent").when(F.col("copies") > 1, "unclear").otherwise("copy")
    return x.select("source", F.concat(F.lit(root.rstrip("/") + "/"), F.col(key)).alias("target"), F.coalesce("copies", F.lit(0)).alias("copies"), state.alias("state"))
