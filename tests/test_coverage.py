import random

from pyspark.sql import functions as F

from chronolex.operators import coverage as C


def brute(rows):
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t >= s:
            by.setdefault(e, []).append((s, t))
    gaps, periods = [], []
    for e, xs in by.items():
        a = b = None
        for s, t in sorted(xs):
            if b is None:
                a, b = s, t
            elif s > b:
                periods.append((e, a, b))
                gaps.append((e, b, s))
                a, b = s, t
            else:
                b = max(b, t)
        periods.append((e, a, b))
    return sorted(gaps), sorted(periods)


def run(spark, rows, shard):
    df = spark.createDataFrame(rows, "who string, s long, e long").withColumn("shard", F.lit("clash")).withColumn("entity", F.lit(1))
    args = {"entity": F.col("who"), "start": F.col("s"), "end": F.col("e"), "shard": shard}
    return sorted(tuple(r) for r in C.gaps(df, **args).collect()), sorted(tuple(r) for r in C.periods(df, **args).collect())


def test_against_brute_force_across_shards(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), s := r.randrange(3000), s + r.choice([0, 1, 5, 40, 700, -3])) for _ in range(160)]
    rows += rows[:20] + [(None, 1, 2), ("a", None, 3), ("b", 4, None)]
    for shard in (10, 100, 10_000):
        assert run(spark, rows, shard) == brute(rows)


def test_touching_nested_and_very_long(spark):
    rows = [("x", 0, 10), ("x", 10, 20), ("x", 5, 7), ("y", 0, 10**15), ("y", 10**12, 10**12 + 1), ("z", -50, -40), ("z", -20, -10)]
    assert run(spark, rows, 16) == ([("z", -40, -20)], [("x", 0, 20), ("y", 0, 10**15), ("z", -50, -40), ("z", -20, -10)])


def test_empty_table(spark):
    assert run(spark, [], 10) == ([], [])


def test_shortest_gap(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 4, 5), ("a", 105, 106)], "k string, s long, e long")
    out = C.gaps(df, entity=F.col("k"), start=F.col("s"), end=F.col("e"), min_length=100)
    assert [tuple(r) for r in out.collect()] == [("a", 5, 105)]
