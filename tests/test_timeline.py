import random

import pytest

from chronolex.operators import timeline as T


def runs(spark, rows):
    return spark.createDataFrame(rows, "k string, o long, cnt long, start double, end double, origin int")


GRID = [("a", i, 1, float(s), float(e), o) for i, (s, e, o) in enumerate([(0, 4, 2), (4, 6, 2), (6, 11, 0), (11, 20, 1), (20, 21, 2)])]


def merged(df):
    return [tuple(r)[2:] for r in df.orderBy("k", "run").collect()]


def test_islands(spark, got):
    df = spark.createDataFrame([("a", i) for i in (9, 3, 4, 5, 8, 12, 4)] + [("b", 1), ("b", None)], "k string, i int")
    assert got(T.islands(df, "k", "i"), "k", "start", "end") == [("a", 12, 12), ("a", 3, 5), ("a", 8, 9), ("b", 1, 1)]
    assert got(T.islands(df, "k", "i", drop_last=True), "k", "start", "end") == [("a", 3, 5), ("a", 8, 9)]
    assert T.islands(df.limit(0), "k", "i").collect() == []


def test_merge_runs(spark):
    x = runs(spark, GRID)
    assert merged(T.merge_runs(x, "k", "o")) == [(2, 0, 6, 2), (1, 6, 11, 0), (1, 11, 20, 1), (1, 20, 21, 2)]
    demoted = T.merge_runs(x, "k", "o", least=7)
    assert merged(demoted) == [(2, 0, 6, 0), (1, 6, 11, 0), (1, 11, 20, 1), (1, 20, 21, 0)]
    assert [tuple(r) for r in T.origin_durations(T.merge_runs(x, "k", "o"), "k").collect()] == [("a", 5, 9, 7)]
    assert [tuple(r) for r in T.origin_durations(demoted, "k").collect()] == [("a", 12, 9, 0)]


def test_two_stages(spark):
    assert merged(T.two_stage_merge(runs(spark, GRID), "k", "o", 7)) == [(2, 0, 6, 0), (1, 6, 11, 0), (2, 11, 21, 1)]


def test_merging_conserves_time(spark):
    r = random.Random(1)
    rows, t = [], 0.0
    for i in range(120):
        d = r.choice([1.0, 2.0, 5.0])
        rows.append(("a", i, 1, t, t + d, r.randrange(3)))
        t += d
    for least in (0.0, 6.0):
        out = T.merge_runs(runs(spark, rows), "k", "o", least=least).collect()
        assert sum(x["end"] - x["start"] for x in out) == pytest.approx(t) and sum(x["cnt"] for x in out) == 120


def test_fallback_grid_and_clock(spark):
    s = spark.createDataFrame([("a", 0, 3.0), ("a", 2, 4.0)], "k string, i int, d double")
    f = spark.createDataFrame([("a", 2, 9.0), ("a", 3, 1.0), ("z", 0, 1.0)], "k string, i int, d double")
    x = T.running_clock(T.fallback_grid(s, f, "k", "i", "d"), "k", "idx")
    assert [(r["start"], r["end"], r["origin"]) for r in x.orderBy("idx").collect()] == [(0, 3, 2), (3, 8, 0), (8, 17, 1), (17, 18, 1)]
    assert x.select("k").distinct().count() == 1


def test_recover_map(spark):
    s = spark.createDataFrame([("a", 1), ("a", 3)], "k string, i int")
    f = spark.createDataFrame([("a", 2), ("a", 3), ("a", 5)], "k string, i int")
    assert T.recover_map(s, f, "k", "i").first()["line"] == "1--[2]--3--[3]--@--[5]"
    assert T.recover_map(s, f.limit(0), "k", "i").first()["line"] == "1--@--3"
