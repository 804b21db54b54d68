import random

import numpy as np
from pyspark.sql import functions as F

from chronolex.llm import clusters as C


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_length():
    r = random.Random(0)
    for _ in range(60):
        a, b = (np.array([r.randrange(5) for _ in range(r.randrange(90))], int) for _ in "ab")
        assert C.common_length(a, b) == slow_lcs(list(a), list(b))


def takes(r, groups, alone):
    """Sequences (key, labels): renderings of takes, and some of their own."""
    new = lambda: [x for _ in range(40) for x in [r.randrange(100)] * r.randrange(1, 6)]
    out, truth = [], set()
    for g, n in enumerate(groups):
        base, names = new(), []
        for i in range(n):
            seq = [x for x in base if r.random() > 0.05]
            for _ in range(4):
                seq[r.randrange(len(seq))] = r.randrange(100)
            names.append(f"g{g}-{i:03d}")
            out.append((names[-1], seq))
        truth |= {(a, b) for a in names for b in names if a < b}
    return out + [(f"x{i}", new()) for i in range(alone)], truth


def test_groups_and_pairs(spark):
    r = random.Random(5)
    rows, truth = takes(r, [2, 3, 40, 7], 60)
    rows += [("empty1", []), ("empty2", []), ("short1", [1, 2]), ("short2", [1, 2])]
    truth.add(("short1", "short2"))
    seqs = spark.createDataFrame(rows, "key string, seq array<int>")
    found = C.density_clusters(seqs, part=8).persist()
    assert {(x["a"], x["b"]) for x in C.cluster_pairs(found, seqs).collect()} == truth
    assert found.count() == len(rows)
    sizes = {x["size"]: x["typical"] for x in C.describe_clusters(found).where("size > 2").collect()}
    assert set(sizes) == {3, 7, 40} and all(len(t) == 3 for t in sizes.values())


def test_one_group_of_equal_copies(spark):
    seqs = spark.range(300).select(F.concat(F.lit("c"), "id").alias("key"), F.array(*map(F.lit, [1, 2, 3, 4, 5, 6, 7])).alias("seq"))
    out = C.density_clusters(seqs, part=16)
    assert out.select("cluster").distinct().count() == 1


def test_sequences_leave_held_sounds_out(spark):
    rows = [("s", p, 9, 0) for p in range(30)] + [("s", 30, 1, 0), ("s", 31, None, 0), ("s", 32, 2, 0), ("s", 32, 3, 1), ("s", 5, 4, 1), (None, 1, 1, 0)]
    df = spark.createDataFrame(rows, "k string, p long, v int, t int").withColumn("ver", F.lit("clash"))
    at = F.timestamp_seconds("t")
    out = C.label_sequences(df, key=F.col("k"), position=F.col("p"), label=F.col("v"), version=at).collect()
    assert [(x["key"], x["seq"]) for x in out] == [("s", [1, 3])]


def test_empty(spark):
    seqs = spark.createDataFrame([], "key string, seq array<int>")
    found = C.density_clusters(seqs)
    assert found.collect() == [] and C.cluster_pairs(found, seqs).collect() == []
