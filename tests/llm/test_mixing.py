import pytest
from pyspark.sql import functions as F

from chronolex.llm.mixing import mix, schedule

TARGETS = [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 1)]


def given(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def documents(spark):
    x = spark.range(4000).select("id", F.when(F.col("id") % 10 < 6, F.lit(" A ")).when(F.col("id") % 10 < 9, F.lit("B")).otherwise(F.lit("c")).alias("source"), (F.col("id") % 90 + 10).alias("n"), F.lit("clash").alias("slot"))
    return x.withColumn("rank", F.lit(1)).withColumn("key", F.lit(2))


def run(spark, df, targets=None, **more):
    return mix(df, key=F.col("id"), source=F.col("source"), size=F.col("n"), targets=targets if targets is not None else given(spark), block=500, **more)


def test_shares_and_repeats(spark):
    df = documents(spark)
    m = run(spark, df)
    report = {r["source"]: r for r in m.report.collect()}
    total = df.agg(F.sum("n")).first()[0]
    for s, share, most in TARGETS:
        r = report[s]
        assert r["tokens"] * most >= r["wanted"] or r["short"]
        if not r["short"]:
            assert abs(r["mixed"] - share * total) < 2500
    assert report["c"]["short"] and report["c"]["mixed"] == report["c"]["tokens"]
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    seen = m.records.groupBy("source", "key").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("n")).collect()
    assert all(r["n"] <= dict((s, k) for s, _, k in TARGETS)[r["source"]] for r in seen)
    assert m.records.groupBy("source", "key", "repetition").count().where("count > 1").count() == 0


def test_every_stretch_has_the_shares(spark):
    x = schedule(spark, TARGETS, 5000)
    assert x.groupBy("source").agg((F.max("rank") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    part = {r["source"]: r["count"] for r in x.where("slot between 1234 and 1333").groupBy("source").count().collect()}
    assert all(abs(part[s] - 100 * t) <= 4 for s, t, _ in TARGETS)


def test_nulls_unknown_sources_huge_documents_and_empty(spark):
    rows = [(1, "a", 10), (2, None, 10), (3, "x", 100), (4, "a", None), (5, "a", -3), (6, "b", 5000), (6, "b", 5000), (None, "a", 7)]
    df = spark.createDataFrame(rows, "id long, source string, n long")
    targets = given(spark, [("A", 0.5, None), ("b", 0.5, 4), ("none", 0.1, 2), (None, 0.2, 1), ("zero", 0.0, 1)])
    m = run(spark, df, targets)
    report = {r["source"]: r for r in m.report.collect()}
    assert set(report) == {"a", "b", "none"} and report["a"]["tokens"] == 17 and report["none"]["short"]
    assert {r["key"] for r in m.records.collect()} <= {1, 6, None}
    empty = run(spark, df.limit(0))
    assert empty.records.count() == 0 and not any(r["short"] for r in empty.report.collect())
    with pytest.raises(ValueError):
        run(spark, df, given(spark, []))
