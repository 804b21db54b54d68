import random

from pyspark.sql import functions as F

from chronolex.operators import batching as B


def test_greedy_bins(spark, got):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "k string, s int")
    assert got(B.greedy_bins(df, "k", "s", bins=2), "k", "bin") == [("a", 0), ("b", 0), ("c", 1)]
    assert got(B.greedy_bins(df, "k", "s", bins=2, keep_last=False), "k") == [("a",), ("b",)]
    r = random.Random(0)
    rows = [(f"{i:04d}", r.randrange(1, 50)) for i in range(300)]
    want, acc, n = [], 0, 0
    for k, s in rows:
        want.append((k, n))
        acc += s
        if acc >= 130:
            acc, n = 0, n + 1
    out = B.flush_chunks(spark.createDataFrame(rows, "k string, s int"), "k", "s", 130)
    assert got(out, "k", "file") == want


def test_fixed_buckets(spark):
    df = spark.range(250).select(F.format_string("%03d", "id").alias("k"))
    out = B.fixed_buckets(df, "k").orderBy("k").collect()
    assert [r["bucket"] for r in out] == [i // 2 for i in range(250)]
    assert B.fixed_buckets(df.limit(3), "k").agg(F.max("bucket")).first()[0] == 2
    assert B.fixed_buckets(df.limit(0), "k").collect() == []


def items(spark, folders):
    rows = [(f, f"{f}{i}", float(d), n) for n, (f, i, d) in enumerate((f, i, d) for f, ds in folders for i, d in enumerate(ds))]
    return spark.createDataFrame(rows, "f string, i string, d double, n long")


ARGS = {"folder": "f", "item": "i", "duration": "d", "position": "n"}


def test_sampler_golden(spark):
    out = B.bucketed_sampler(items(spark, [("x", [5, 1, 4, 2, 3, 6])]), **ARGS, batch=1, replicas=2, scale=2).orderBy("pos").collect()
    assert [r["item"] for r in out] == ["x1", "x3", "x2", "x0", "x4", "x5"]
    assert [r["item"] for r in out if r["rank"] == 0] == ["x1", "x2", "x4"]


def test_sampler_pads_shuffles_and_drops(spark):
    df = items(spark, [("b", [3, 1]), ("a", [9, 8, 7, 6, 5, 4, 3])])
    out = B.bucketed_sampler(df, **ARGS, batch=2, replicas=4, scale=1).collect()
    assert sorted(r["pos"] for r in out) == list(range(12)) and len({r["item"] for r in out}) == 9
    shuffled = [B.bucketed_sampler(df, **ARGS, batch=1, replicas=3, scale=2, seed=4, epoch=e).orderBy("pos").collect() for e in (0, 0, 1)]
    order = [[r["item"] for r in s] for s in shuffled]
    assert order[0] == order[1] != order[2] and all(sorted(o) == sorted(order[0]) for o in order)
    dropped = B.bucketed_sampler(df, **ARGS, batch=1, replicas=4, scale=2, drop_last=True)
    assert sorted(r["pos"] for r in dropped.collect()) == list(range(8))


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("bucket"))
    assert B.validation_split(df, "bucket", 0.35).where("side = 'val'").select("bucket").distinct().count() == 3
    assert B.validation_split(df, "bucket", 0.35, at_most_one=True).where("side = 'val'").select("bucket").distinct().count() == 1
    assert B.validation_split(df.limit(0), "bucket", 0.1).collect() == []
    n = B.hash_split(df, "id", {"a": 0.8, "b": 0.2}).where("side = 'a'").count()
    assert abs(n - 800) < 60
    assert sorted(r["id"] for r in B.permuted(df, "id", 1).collect()) == list(range(1000))
