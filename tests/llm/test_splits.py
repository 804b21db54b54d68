import random

import pytest
from pyspark.sql import functions as F

from chronolex.llm import splits as S


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    got = {r["node"]: r["component"] for r in S.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == want


TARGETS = [("train", 0.8), ("dev", 0.1), ("test", 0.1)]


def test_related_records_stay_together_in_the_shares(spark):
    df = spark.range(6000).select(F.concat(F.lit("a"), F.col("id") % 500).alias("author"), F.when(F.col("id") % 11 == 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), "id", F.lit(1).alias("e"), F.lit("c").alias("component2"))
    out = S.split_related(df.withColumn("source", F.lit(None).cast("string")), [F.col("author"), F.col("source")], TARGETS).persist()
    assert out.count() == 6000
    assert out.groupBy("author").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    share = {r["side"]: r["count"] / 6000 for r in out.groupBy("side").count().collect()}
    assert all(abs(share[s] - t) < 0.05 for s, t in TARGETS)
    linked = S.split_related(df, [F.col("author"), F.col("source")], TARGETS)
    assert linked.groupBy("source").agg(F.count_distinct("component").alias("n")).where("source is not null and n > 1").count() == 0


def test_giant_component_goes_where_it_fits(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("giant")).otherwise(F.col("id").cast("string")).alias("k"))
    out = S.split_related(df, [F.col("k")], TARGETS)
    n = {r["side"]: r["count"] for r in out.groupBy("side").count().collect()}
    assert out.where("k = 'giant'").select("side").distinct().collect()[0]["side"] == "train"
    assert abs(n["dev"] - 300) < 80 and abs(n["test"] - 300) < 80


def test_records_without_entity_repeats_and_clashes(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2), ("a", 2), (None, 3)], "k string, x int")
    out = S.split_related(df, [F.col("k")], TARGETS).collect()
    assert len(out) == 5 and {r["side"] for r in out if r["x"] == 1}.__len__() == 1
    assert all(r["component"] is None for r in out if r["k"] is None)
    with pytest.raises(ValueError):
        S.split_related(df.withColumn("side", F.lit(1)), [F.col("k")], TARGETS)
    assert S.split_related(df.limit(0), [F.col("k")], TARGETS).collect() == []


def test_hubs_are_salted_and_the_components_are_the_same(spark, got, monkeypatch):
    from chronolex.llm import splits as S

    hub = [("m", f"n{i:03d}") for i in range(60)] + [(f"n{i:03d}", f"z{i:03d}") for i in range(0, 60, 3)] + [("a", "b"), ("b", "c"), ("x", "x")]
    edges = spark.createDataFrame(hub, "u string, v string")
    plain = got(S.components(edges))
    assert {c for _, c in plain} == {"m", "a", "x"} and len(plain) == 1 + 60 + 20 + 3 + 1
    monkeypatch.setattr(S, "HUB", 5)
    monkeypatch.setattr(S, "SALTS", 4)
    assert got(S.components(edges)) == plain
