import pytest
from pyspark.sql import functions as F

from chronolex.operators import filters as L
from chronolex.operators import stats as S
from chronolex.operators.ranking import global_rank

NAN = float("nan")


def values(spark):
    return spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, NAN), (5, None)], "id int, x double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_bounds(spark):
    df = values(spark)
    assert ids(L.apply_filters(df, [L.at_least("x", 2)])) == [2, 3]
    assert ids(L.apply_filters(df, [L.at_most("x", 2)])) == [1, 2]
    assert ids(L.apply_filters(df, L.inside("x", 1, 3))) == [2]
    assert ids(L.apply_filters(df, [])) == [1, 2, 3, 4, 5]
    with pytest.raises(KeyError):
        L.apply_filters(df, [L.at_least("y", 1)])
    with pytest.raises(ValueError):
        L.apply_filters(df, [L.at_least("x", 9)], fail_if_empty=True)


def test_bounds_reach_the_scan(spark, tmp_path):
    values(spark).write.parquet(str(tmp_path / "t"))
    plan = L.apply_filters(spark.read.parquet(str(tmp_path / "t")), [L.at_least("x", 2)]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,2.0)" in plan


def test_membership_and_audit(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r["k"] for r in L.member(df, keys, ["k"]).collect()] == ["a"]
    assert {r["k"] for r in L.member(df, keys, ["k"], negate=True).collect()} == {"b", None}
    dirty = spark.createDataFrame([("", 1.0, 1), ("None", NAN, None), ("x", None, 3)], "s string, `d.x` double, i int")
    assert {r["column"]: r["bad"] for r in L.null_audit(dirty).collect()} == {"s": 2, "d.x": 2, "i": 1}
    assert L.null_total(dirty).first()["bad"] == 5
    assert L.null_total(dirty.limit(0)).first()["bad"] == 0


def test_empirical_percentile(spark, got):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([40.0, 10.0, 30.0, 20.0, NAN])] + [(9, None)], "id int, x double")
    assert got(S.empirical_percentile(df, "x", ["id"]), "x", "pct") == [(10, 0), (20, 0.25), (30, 0.5), (40, 0.75)]
    many = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    out = S.empirical_percentile(many, "x", ["id"]).orderBy("x", "id").collect()
    assert [r["pct"] for r in out] == [i / 2000 for i in range(2000)]
    assert S.empirical_percentile(df.limit(0), "x", ["id"]).collect() == []


def test_global_rank(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x"), F.lit("clash").alias("rank0"))
    assert all(r["x"] == r["rank"] for r in global_rank(df.repartition(7), ["x"]).collect())
    nulls = spark.createDataFrame([(2, "b"), (None, "a"), (2, "a")], "x int, y string")
    assert {(r["x"], r["y"]): r["rank"] for r in global_rank(nulls, ["x", "y"]).collect()} == {(None, "a"): 0, (2, "a"): 1, (2, "b"): 2}
    assert global_rank(df.limit(0), ["x"]).collect() == []


def test_nested_means_hours_and_clock(spark):
    df = spark.createDataFrame([("r0", 1, 1.0), ("r0", 2, 3.0), ("r1", 1, 5.0)], "rank string, batch int, v double")
    assert S.mean_of_means(df, "rank", "batch", "v").first()[0] == 3.5
    assert values(spark).agg(S.hours(F.col("x"))).first()[0] == 6 / 3600
    assert values(spark).limit(0).agg(S.hours(F.col("x"))).first()[0] == 0
    assert spark.range(1).select(S.minutes_seconds(F.lit(125.9))).first()[0] == "2:5"


def test_quality_preset_and_its_parameters(spark):
    b = L.quality_bounds(duration__segments_lb=2, missed_chars_percentage__segments=0.1)
    assert len(b) == 14 and [x.value for x in b if x.name == "duration__segments"] == [54, 2] and [x.value for x in b if x.name == "missed_chars_percentage__segments"] == [0.1, 0.1]
    with pytest.raises(KeyError):
        L.quality_bounds(nothing=1)
    good = {x.name: x.value + (-0.001 if x.upper else 0.001) for x in L.QUALITY} | {"duration__segments": 10.0, "missed_chars_percentage__segments": 0.051}
    rows = [good] + [good | {x.name: x.value + (0.001 if x.upper else -0.001)} for x in L.QUALITY] + [good | {x.name: None} for x in L.QUALITY] + [good | {x.name: float("nan")} for x in L.QUALITY]
    names = list(good)
    df = spark.createDataFrame([tuple(None if r[n] is None else float(r[n]) for n in names) for r in rows], ", ".join(f"{n} double" for n in names))
    kept = L.apply_filters(df, L.QUALITY).collect()
    assert all(tuple(k) == tuple(float(good[n]) for n in names) for k in kept) and len(kept) == 1
