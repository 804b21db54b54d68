import numpy as np
from pyspark.sql import functions as F

from chronolex.llm import quantiles as Q


def true_error(values, answer, share):
    values = np.sort(values)
    rank = min(max(1, int(np.ceil(share * len(values)))), len(values))
    low, high = np.searchsorted(values, answer, "left") + 1, np.searchsorted(values, answer, "right")
    return max(rank - high, low - rank, 0)


def test_merges_keep_the_stated_error():
    r = np.random.default_rng(0)
    for draw in (lambda n: r.normal(size=n), lambda n: r.integers(0, 9, n).astype(float), lambda n: np.sort(r.random(n))):
        parts = [draw(n) for n in (1, 3, 50, 4000, 900, 2500, 7, 10_000)]
        everything = np.concatenate(parts)
        level = [Q.compress(Q.summarise(p), 0.01 * len(p)) for p in parts]
        while len(level) > 1:
            merged = [Q.merge(level[i : i + 2]) for i in range(0, len(level), 2)]
            level = [Q.compress(s, 0.02 * s[3]) for s in merged]
        s = level[0]
        assert s[3] == len(everything) and len(s[0]) < 400
        for share in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
            value, bound = Q.quantile(s, share)
            assert true_error(everything, value, share) <= bound <= Q.rank_error(s) <= 0.02 * len(everything)


def test_small_summaries_are_exact():
    s = Q.summarise(np.array([5.0, 1.0, 1.0, 9.0]))
    assert [Q.quantile(s, q) for q in (0.25, 0.5, 0.75, 1.0)] == [(1.0, 0), (1.0, 0), (5.0, 0), (9.0, 0)]
    assert Q.quantile(Q.merge([]), 0.5) == (None, None)


def table(spark, n=30_000):
    x = spark.range(n, numPartitions=7).select((F.col("id") % 3 == 0).alias("hot"), F.rand(4).alias("x"), F.lit("clash").alias("g"), F.lit("clash").alias("part"))
    return x.select(F.when(F.col("hot"), F.lit("a")).otherwise(F.lit("b")).alias("k"), "x", "g", "part")


def test_grouped_percentiles_and_days(spark):
    df = table(spark).persist()
    bad = spark.createDataFrame([("a", float("nan")), ("a", None), ("a", float("inf")), ("z", None), (None, 1.0)], "k string, x double")
    both = df.unionByName(bad, allowMissingColumns=True)
    out = {r["k"]: r for r in Q.grouped_percentiles(both, {"k": F.col("k")}, F.col("x"), [0.5, 0.9], eps=0.02).collect()}
    assert set(out) == {"a", "b", None} and out[None]["percentiles"][0]["value"] == 1.0
    for k in "ab":
        xs = np.array([r["x"] for r in df.where(F.col("k") == k).collect()])
        assert out[k]["n"] == len(xs)
        for p in out[k]["percentiles"]:
            assert true_error(xs, p["value"], p["share"]) <= p["error"] <= 0.02 * len(xs)
    days = [Q.merge_summaries(Q.partition_summaries(part, [F.col("k")], F.col("x"), 0.02), 0.02).withColumn("part", F.lit(i)) for i, part in enumerate(df.randomSplit([0.3, 0.7], 1))]
    whole = Q.percentiles(Q.merge_summaries(days[0].unionByName(days[1]), 0.03, largest_part=1), ["k"], [0.5]).collect()
    assert {r["k"]: r["n"] for r in whole} == {"a": out["a"]["n"], "b": out["b"]["n"]}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert Q.grouped_percentiles(df, {"k": F.col("k")}, F.col("x"), [0.5]).collect() == []
