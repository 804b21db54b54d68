"""Many small files into few well-sized sorted ones: problem 1.

The records are made distinct by their key, range-partitioned by the key over boundaries that
Spark samples from the data, sorted inside each range and written to a staging folder, one file
a range of about the target size. Two reconciliations come before the swap: the distinct records,
each weighted by how often it occurred, against a separate pass over the source; and the
staged files against the distinct records, over all columns. Only then a pointer file moves on from
the earlier table to the staged one, so readers find a whole table at any time.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.shared import fresh_path, remove

TARGET = 64 * 1024
BLANKS = " \t\f\x0b"
#: A whole line of two runs of digits parted by one sign that is no letter or digit.
LINE = r"(?<![^\r\n])[ \t\f\x0b]*[0-9]+[^0-9A-Za-z\r\n][0-9]+[ \t\f\x0b]*(?![^\r\n])"


@dataclass(frozen=True)
class Compacted:
    """Where the files are, how many records and files, and bytes of the largest and of all files."""

    path: str
    records: int
    files: int
    largest: int
    bytes: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(current(spark, self.path))


def parse_label_files(files: DataFrame) -> DataFrame:
    """Records (recording, segment long, frame long, km100 int, file_id) of label files, repeats kept.

    A record is a line of a frame number and a label parted by one sign; lines may end in any way.
    The segment is named by ``segm``, else by ``segment_path``: the last two numbers of it.
    Files of unknown segments, null and empty bodies hold no record, and numbers that do not fit into a
    long and an int make none (``unreadable_lines`` counts those).
    """
    name = r"(\d{16})\D+(\d{1,18})\D*$"
    x = files.select("file_id", "body", *(F.regexp_extract(F.col(c), name, i).alias(f"{c}{i}") for c in ("segm", "segment_path") for i in (1, 2)))
    has = (F.col("segm1") != "") & F.col("segm1").isNotNull()
    x = x.select(
        "file_id",
        F.when(has, F.col("segm1")).otherwise(F.nullif("segment_path1", F.lit(""))).alias("recording"),
        F.when(has, F.col("segm2")).otherwise(F.col("segment_path2")).try_cast("long").alias("segment"),
        F.explode(F.regexp_extract_all("body", F.lit(LINE), F.lit(0))).alias("line"),
    ).where("recording is not null and segment is not null")
    x = x.select("recording", "segment", "file_id", F.btrim("line", F.lit(BLANKS)).alias("line")).withColumn("sign", F.translate("line", "0123456789", ""))
    frame, label = F.expr("try_cast(substring_index(line, sign, 1) as long)"), F.expr("try_cast(substring_index(line, sign, -1) as int)")
    return x.select("recording", "segment", frame.alias("frame"), label.alias("km100"), "file_id").where("frame is not null and km100 is not null")


def unreadable_lines(files: DataFrame) -> DataFrame:
    """(file_id, lines): lines that look like a record but whose numbers are too large to be read."""
    x = files.select("file_id", F.explode(F.regexp_extract_all("body", F.lit(LINE), F.lit(0))).alias("line"))
    x = x.select("file_id", F.btrim("line", F.lit(BLANKS)).alias("line")).withColumn("sign", F.translate("line", "0123456789", ""))
    x = x.where("try_cast(substring_index(line, sign, 1) as long) is null or try_cast(substring_index(line, sign, -1) as int) is null")
    return x.groupBy("file_id").agg(F.count("*").alias("lines"))


def first_of_key(records: DataFrame, key: list[str], order: str | None, times: str | None = None) -> DataFrame:
    """One row a key, that of the smallest ``order``; ties go to the smallest of the other columns.

    ``times`` names a column for the number of rows the key had. Pre-aggregated before the
    shuffle, so a key repeated any number of times arrives once a task.
    """
    rest = [c for c in records.columns if c not in {*key, order}]
    value = [c for c in (order, *rest) if c is not None]
    aggs = [F.min(F.struct(*value)).alias("__first")] if value else []
    x = records.groupBy(*key).agg(*aggs, F.count("*").alias(times or "__times"))
    return x.select(*key, *(F.col("__first")[c].alias(c) for c in value), *([times] if times else []))


def _sum_of(hashes: Column) -> Column:
    """A sum of hashes that cannot overflow below 2**39 rows."""
    return F.coalesce(F.sum(F.shiftrightunsigned(hashes, 40)), F.lit(0))


def _mark(df: DataFrame, columns: list[str]) -> tuple:
    """Rows, and two checksums of the given columns."""
    h = F.xxhash64(*columns)
    return tuple(df.agg(F.count("*"), _sum_of(h), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def _occurrences(df: DataFrame, key: list[str], times: Column) -> tuple:
    """Rows of the source and a checksum of their keys, each row standing for ``times`` of them."""
    return tuple(df.agg(F.coalesce(F.sum(times), F.lit(0)), F.coalesce(F.sum(F.shiftrightunsigned(F.xxhash64(*key), 40) * times), F.lit(0))).first())


def compact(records: DataFrame, key: list[str], path: str, order: str | None = None, target_bytes: int = TARGET, sample_rows: int = 100_000) -> Compacted:
    """Write the first record of each key as sorted files of about ``target_bytes`` under ``path``.

    ``records`` may repeat a key: the row of the smallest ``order`` counts, ties go to the smallest of the
    other columns. Bytes a row are measured on at most ``sample_rows`` rows that are written and
    looked at; every record is written. Files hold disjoint ranges of the key. Nothing becomes visible and
    RuntimeError is raised where the distinct records do not account for every row of the source, or the
    written files for every record in all its columns. ``path`` holds the table in a folder of its
    own and, written last, the pointer ``_current`` to it: readers go by ``current``. An earlier table
    under ``path`` is removed after that. An empty table gives one empty file. Nulls in the key
    are a value.
    """
    spark = records.sparkSession
    raw, trial, staging = fresh_path(spark, "raw"), fresh_path(spark, "trial"), f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"
    columns = records.columns
    try:
        first_of_key(records, key, order, "__times").write.parquet(raw)
        once = spark.read.parquet(raw)
        source, counted = _occurrences(records, key, F.lit(1).cast("long")), _occurrences(once, key, F.col("__times"))
        if source != counted:
            raise RuntimeError(f"the distinct records stand for {counted} rows and keys, the source has {source}; {path} is unchanged")
        once = once.select(*columns)
        want = _mark(once, columns)
        tried = min(want[0], sample_rows)
        once.limit(tried).repartitionByRange(1, *key).sortWithinPartitions(*key).write.parquet(trial)
        per_row = _sizes(spark, trial)[1] / max(1, tried)
        count = max(1, math.ceil(want[0] * per_row / target_bytes))
        _in_ranges(once, key, count).write.parquet(staging)
        got = _mark(spark.read.parquet(staging), columns)
        if got != want:
            raise RuntimeError(f"staged records {got} are not those given {want}; {path} is unchanged")
    except BaseException:
        remove(spark, staging)
        raise
    finally:
        remove(spark, raw)
        remove(spark, trial)
    _point(spark, path, staging)
    largest, total, files = _sizes(spark, staging)
    return Compacted(path, want[0], files, largest, total)


def _in_ranges(records: DataFrame, key: list[str], count: int) -> DataFrame:
    return records.repartitionByRange(count, *key).sortWithinPartitions(*key)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _sizes(spark: SparkSession, path: str) -> tuple[int, int, int]:
    fs, p = _fs(spark, path)
    sizes = [f.getLen() for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet")]
    return max(sizes, default=0), sum(sizes), len(sizes)


def _point(spark: SparkSession, path: str, folder: str) -> None:
    """Make ``folder`` the table of ``path`` by one rename of its pointer; then the earlier one goes."""
    fs, place = _fs(spark, path)
    name = folder.rsplit("/", 1)[-1]
    _, new = _fs(spark, f"{path}/_next-{name}")
    out = fs.create(new, True)
    out.write(bytearray(name, "utf-8"))
    out.close()
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(_fs(spark, f"{path}/_current")[1]), overwrite)
    for old in fs.listStatus(place):
        if old.getPath().getName() not in (name, "_current"):
            fs.delete(old.getPath(), True)


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the table of ``path`` now."""
    return f"{path.rstrip('/')}/{_text(spark, f'{path}/_current')}"


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
