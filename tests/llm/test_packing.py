import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolex.llm import packing as P


def checked(spark, sizes, capacity=100, **more):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc long, n long").withColumn("size", F.lit("clash")).withColumn("g", F.lit(1))
    rows = [tuple(r) for r in P.pack(df, key=F.col("doc"), size=F.col("n"), capacity=capacity, **more).collect()]
    whole, load = Counter(), Counter()
    for doc, piece, size, container in rows:
        whole[doc] += size
        if container is None:
            assert size == 0
        else:
            load[container] += size
    assert all(whole[i] == max(0, s or 0) for i, s in enumerate(sizes)) and len(whole) == len(sizes)
    assert all(0 < x <= capacity for x in load.values())
    pieces = Counter(r[0] for r in rows)
    assert all(n == max(1, -(-(sizes[d] or 0) // capacity)) for d, n in pieces.items())
    return len(load)


def first_fit(sizes, capacity):
    free = []
    for s in sorted((x for s in sizes for x in [capacity] * (s // capacity) + [s % capacity] if x), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= s), None)
        if at is None:
            free.append(capacity - s)
        else:
            free[at] -= s
    return len(free)


def test_near_the_bound_and_no_worse_than_first_fit(spark):
    r = random.Random(4)
    sizes = [r.choice([r.randrange(1, 12), r.randrange(20, 60), r.randrange(30, 100), 250]) for _ in range(1500)]
    used = checked(spark, sizes)
    assert used <= 1.02 * first_fit(sizes, 100) + 2


def test_hot_size_shards_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    sizes = [34] * 400 + [33] * 100 + [3] * 300
    assert checked(spark, sizes, shard_rows=90) <= first_fit(sizes, 100) + 10  # one open container a shard


def test_edges(spark):
    assert checked(spark, []) == 0
    assert checked(spark, [None, 0, -5]) == 0
    assert checked(spark, [100, 100, 200, 1000]) == 14
    assert checked(spark, [1]) == 1
    assert checked(spark, [51, 51, 51]) == 3
    assert checked(spark, [101]) == 2


def test_configurations_hold_all_items():
    r = random.Random(0)
    for _ in range(20):
        sizes = sorted(r.sample(range(10, 90), 5), reverse=True)
        counts = [r.randrange(1, 60) for _ in sizes]
        plan = P.configurations(sizes, counts, 100)
        assert [sum(c[i] * n for c, n in plan) for i in range(5)] == counts
        assert all(sum(k * s for k, s in zip(c, sizes)) <= 100 for c, _ in plan)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_null_and_repeated_keys(spark, kind):
    df = spark.createDataFrame([(None, 30), (None, 30), ("7", 60), ("7", 60)], "k string, n int").withColumn("k", F.col("k").cast(kind))
    out = P.pack(df, key=F.col("k"), size=F.col("n"), capacity=64)
    assert out.count() == 4 and out.schema["key"].dataType.simpleString() == kind
