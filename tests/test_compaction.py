import pytest
from pyspark.sql import functions as F

from chronolex.operators import compaction as C
from chronolex.shared import fresh_path

FILES = "file_id long, body string, segm string, segment_path string, extra string"
A = "2003010618271841"


def files(spark, *rows):
    return spark.createDataFrame([(*r, "x")[:5] for r in rows], FILES)


def test_lines_of_every_kind(spark, got):
    df = files(
        spark,
        (1, "frame,km100\r\n0,5\r\n1,6\r\n\r\n2,", f"{A}/07", None),
        (2, "frame\tkm100\n1\t6\n3\t9", None, f"/srv/x//{A}/007/"),
        (3, "4;7\r5;8", f" sentences_{A}//7 ", "junk"),
        (4, None, f"{A}/7", None),
        (5, "", f"{A}/7", None),
        (6, "9,9", None, None),
        (7, "a,1\n1,b\n1,2,3\n7 8", f"{A}/8", None),
    )
    assert got(C.parse_label_files(df), "segment", "frame", "km100", "file_id") == [(7, 0, 5, 1), (7, 1, 6, 1), (7, 1, 6, 2), (7, 3, 9, 2), (7, 4, 7, 3), (7, 5, 8, 3), (8, 7, 8, 7)]


def test_compacted_table_is_whole_sorted_and_replaces(spark, got):
    df = spark.range(20_000).select((F.col("id") % 50).cast("string").alias("recording"), (F.col("id") % 7).alias("segment"), F.col("id").alias("frame"), F.lit(1).alias("km100"), F.lit(3).cast("long").alias("file_id"))
    doubled = df.unionByName(df.withColumn("file_id", F.lit(9).cast("long")))
    path = fresh_path(spark, "t")
    key = ["recording", "segment", "frame"]
    spark.range(3).write.parquet(path)
    done = C.compact(doubled, key, path, order="file_id", target_bytes=16 * 1024)
    assert done.records == 20_000 and done.files > 3 and done.largest < 3 * 16 * 1024
    back = done.read(spark)
    assert got(back.agg(F.count("*"), F.count_distinct(*key), F.max("file_id"))) == [(20_000, 20_000, 3)]
    spans = back.groupBy(F.input_file_name().alias("f")).agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).orderBy("a").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(spans, spans[1:]))


def test_empty_and_null_keys(spark):
    empty = spark.createDataFrame([], "a string, b long")
    assert C.compact(empty, ["a"], fresh_path(spark, "t")).records == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("x", None)], "a string, b long")
    assert C.compact(nulls, ["a", "b"], fresh_path(spark, "t")).read(spark).count() == 3


def test_failed_reconciliation_keeps_the_old_table(spark, monkeypatch):
    path = fresh_path(spark, "t")
    spark.range(3).write.parquet(path)
    marks = iter([(2, 1), (1, 1)])
    monkeypatch.setattr(C, "_mark", lambda *a: next(marks))
    with pytest.raises(RuntimeError):
        C.compact(spark.range(2), ["id"], path)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("broken", ["lost", "altered", "doubled"])
@pytest.mark.parametrize("step", ["first_of_key", "_in_ranges"])
def test_a_row_lost_or_altered_on_the_way_is_seen(spark, monkeypatch, step, broken):
    path = fresh_path(spark, "t")
    rows = spark.range(50).select("id", (F.col("id") * 2).alias("value"))
    C.compact(rows, ["id"], path)
    before = C.current(spark, path)
    right = getattr(C, step)

    def wrong(*a):
        x = right(*a)
        if broken == "lost":
            return x.where("id <> 7")
        if broken == "doubled":
            return x.unionByName(x.where("id = 7"))
        column = "id" if step == "first_of_key" else "value"  # what only the copy may not change
        return x.withColumn(column, F.when(F.col("id") == 7, -1).otherwise(F.col(column)))

    monkeypatch.setattr(C, step, wrong)
    with pytest.raises(RuntimeError):
        C.compact(rows, ["id"], path)
    assert C.current(spark, path) == before and spark.read.parquet(before).count() == 50


def test_numbers_too_large_are_counted(spark, got):
    df = files(spark, (1, "12345678901234567890,1\n1,99999999999\n2,3\n4, 5", f"{A}/07", None))
    assert got(C.unreadable_lines(df)) == [(1, 2)] and got(C.parse_label_files(df), "frame", "km100") == [(2, 3)]
