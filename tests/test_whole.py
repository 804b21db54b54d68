"""Queries over small tables whose rows lie where a cut would lose them, against brute force."""

import random

import pytest

from chronolex.operators import relational, timeline
from chronolex.plans import aggregates, joins

SEGMENTS = "recording string, idx long, type string, duration double, words long"


@pytest.fixture
def segments(spark, monkeypatch):
    def use(rows):
        df = spark.createDataFrame(rows, SEGMENTS)
        for m in (joins, aggregates):
            monkeypatch.setattr(m, "segments", lambda s, d: df)

    return use


FAR = [("a", 9000, "train", 2.0, 1), ("a", 9001, "other", 3.0, 1), ("a", 9003, "train", 4.0, 1), ("b", 1, "train", 1.0, 1), ("c", 5000, "other", 1.0, 1)]


def test_grid_of_far_indexes(spark, got, segments):
    segments(FAR)
    have = {(r, i): (1 if t == "other" else 2, d) for r, i, t, d, _ in FAR}
    x = joins.stretches(spark, "")
    want, clock = [], []
    for key, top in (("a", 9003), ("b", 1)):
        end = 0.0
        for i in range(top + 1):
            origin, d = have.get((key, i), (0, 5.0))
            want.append((key, i, origin, d))
            clock.append((key, i, end, end + d))
            end += d
    assert got(timeline.unfold(x, "recording"), "recording", "idx", "origin", "duration") == sorted(want, key=repr)
    assert got(timeline.unfold(timeline.running_clock(x, "recording", "idx"), "recording"), "recording", "idx", "start", "end") == sorted(clock, key=repr)
    assert got(joins.fallback_grid(spark, "")) == [("a", 0, 9000, 0, 45000.0), ("a", 9000, 1, 2, 2.0), ("a", 9001, 1, 1, 3.0), ("a", 9002, 1, 0, 5.0), ("a", 9003, 1, 2, 4.0), ("b", 0, 1, 0, 5.0), ("b", 1, 1, 2, 1.0)]
    assert got(aggregates.running_clock(spark, ""))[:3] == [("a", 0, 9000, 0.0, 45000.0), ("a", 9000, 1, 45000.0, 45002.0), ("a", 9001, 1, 45002.0, 45005.0)]
    assert got(joins.recover_map(spark, "")) == [("a", "9000--[9001]--@--9003"), ("b", "1")]
    assert got(aggregates.origin_durations(spark, "")) == [("a", 45005.0, 3.0, 6.0), ("b", 5.0, 0.0, 1.0)]
    runs = [("a", 1, 9000, 0.0, 45000.0, 0), ("a", 2, 1, 45000.0, 45002.0, 2), ("a", 3, 1, 45002.0, 45005.0, 1), ("a", 4, 1, 45005.0, 45010.0, 0), ("a", 5, 1, 45010.0, 45014.0, 2), ("b", 1, 1, 0.0, 5.0, 0), ("b", 2, 1, 5.0, 6.0, 2)]
    assert got(aggregates.merge_runs(spark, "")) == runs
    assert got(aggregates.merge_runs_constrained(spark, "")) == [r[:5] + (0,) for r in runs]
    assert got(aggregates.two_stage_merge(spark, ""), "recording", "run", "cnt") == [("a", 1, 9000), ("a", 2, 2), ("a", 3, 1), ("a", 4, 1), ("b", 1, 1), ("b", 2, 1)]


def test_bins_of_all_types(spark, got, segments):
    rows = [("a", i, t, 1.0, (7 * i) % 40) for t in ("train", "other", "context_dev") for i in range(300)]
    segments(rows)
    bins, files = [], []
    for t in ("train", "other", "context_dev"):
        items = sorted((f"{r}/{i}", w) for r, i, kind, _, w in rows if kind == t)
        for out, limit in ((bins, sum(w for _, w in items) / 4), (files, 100)):
            acc = n = 0
            for k, w in items:
                out.append((t, n, k, float(w)))
                acc += w
                if acc >= limit:
                    acc, n = 0, n + 1
    assert got(aggregates.greedy_bins(spark, "")) == sorted(bins, key=repr)
    assert got(aggregates.flush_chunks(spark, "")) == sorted(files, key=repr)


def test_frames_of_far_segments(spark, got, segments):
    segments([("a", 3, "train", 1.0, 2), ("a", 20, "train", 1.0, 1), ("a", 10_000_000, "other", 1.0, 3), ("b", 50, "other", 1.0, 0)])
    want = [("a", i, f, f"a/{i}/{f}") for i, n in ((3, 2), (20, 1), (10_000_000, 3)) for f in range(n)]
    assert got(aggregates.frame_ids(spark, "")) == sorted(want, key=repr)


def test_points_in_intervals_of_any_length(spark, got):
    r = random.Random(4)
    ranges = [(k, a, a + r.choice([0, 3, 70, 5000]), i) for i, (k, a) in enumerate((k, r.randrange(10_000_100)) for k in "ab" for _ in range(60))] + [("a", 9, 5, 900), ("a", None, 5, 901), (None, 0, 9, 902)]
    points = [(k, p) for k in "ab" for p in [*(r.randrange(10_000_100) for _ in range(200)), *(a for _, a, _, _ in ranges if a is not None)]] + [("a", None)]
    x = spark.createDataFrame(points, "k string, p long")
    y = spark.createDataFrame(ranges, "k string, a long, b long, i int")
    want = [(k, p, i) for k, p in points for q, a, b, i in ranges if k == q and p is not None and a is not None and a <= p <= b]
    assert got(relational.interval_join(x, y, ["k"], "p", "a", "b"), "k", "p", "i") == sorted(want, key=repr)
    assert relational.interval_join(x, y.where("false"), ["k"], "p", "a", "b").count() == 0
    theta = relational.theta_join(x, y, ["k"], x["p"] > y["b"])
    assert theta.count() == sum(k == q and p is not None and b is not None and p > b for k, p in points for q, a, b, i in ranges)
