import random

from pyspark.sql import functions as F

from chronolex.llm.held import held_runs


def brute(rows, slip):
    """Held stretches from (key, pos, label, version)."""
    best = {}
    for k, p, v, t in rows:
        if k is not None and p is not None:
            best[k, p] = max(best.get((k, p), (-1, -1)), (-1 if t is None else t, -1 if v is None else v))
    by = {}
    for (k, p), (_, v) in best.items():
        if v >= 0:
            by.setdefault((k, v), []).append(p)
    out = []
    for (k, v), ps in by.items():
        ps.sort()
        a = b = ps[0]
        n = 1
        for p in ps[1:]:
            if p - b <= slip + 1:
                b, n = p, n + 1
            else:
                out.append((k, v, a, b, b - a + 1, n))
                a = b = p
                n = 1
        out.append((k, v, a, b, b - a + 1, n))
    return sorted(out)


def run(spark, rows, slip=2, block=16, **more):
    df = spark.createDataFrame(rows, "segm string, frame long, km int, at int").withColumn("k", F.lit(1)).withColumn("b", F.lit("clash"))
    out = held_runs(df, key=F.col("segm"), position=F.col("frame"), label=F.col("km"), version=F.col("at"), max_slip=slip, block=block, **more)
    return sorted(tuple(r) for r in out.collect())


def test_random_sequences_over_any_blocks(spark):
    r = random.Random(1)
    rows = [(k, p, r.choice([1, 1, 1, 2, None]), 0) for k in ("a", "b/1") for p in range(200) if r.random() > 0.1]
    rows += [(k, p, 2, 5) for k, p, _, _ in rows[::17]] + rows[:30] + [(None, 1, 1, 0), ("a", None, 1, 0), ("a", 500, None, 9)]
    r.shuffle(rows)
    for slip, block in ((2, 4), (2, 37), (0, 8), (2, 10_000)):
        assert run(spark, rows, slip, block) == brute(rows, slip)


def test_least_length_and_seconds(spark):
    rows = [("s", p, 7, None) for p in range(10, 40)] + [("s", 60, 7, None)]
    assert run(spark, rows, min_length=25, rate=50.0) == [("s", 7, 10, 39, 30, 30, 0.6)]


def test_later_null_label_takes_the_place(spark):
    assert run(spark, [("s", 1, 4, 0), ("s", 1, None, 1), ("s", 2, 4, 0)]) == [("s", 4, 2, 2, 1, 1)]


def test_negative_positions_and_empty(spark):
    assert run(spark, [("s", -1, 3, 0), ("s", 0, 3, 0)], block=8) == [("s", 3, -1, 0, 2, 2)]
    assert run(spark, []) == []
