import random
from itertools import combinations

import numpy as np

from chronolex.llm import clusters as C


def brute(rows):
    out = {}
    for (a, x), (b, y) in combinations(sorted(rows), 2):
        short, long = sorted((len(x), len(y)))
        if short and long <= 2 * short and (share := C.common_length(np.array(x), np.array(y)) / short) >= 0.65:
            out[a, b] = share
    return out


def test_pairs_without_four_equal_labels_in_a_row(spark):
    base = list(range(60))
    rows = [("a", base), ("b", [200 + v if i % 3 == 2 else v for i, v in enumerate(base)]), ("short1", [1, 2, 3]), ("short2", [1, 9, 3])]
    seqs = spark.createDataFrame(rows, "key string, seq array<int>")
    assert {(x["a"], x["b"]) for x in C.similar_pairs(seqs).collect()} == {("a", "b"), ("short1", "short2")}
    assert {x["size"] for x in C.describe_clusters(C.density_clusters(seqs)).collect()} == {2}
    assert C.density_clusters(seqs).select("cluster").distinct().count() == 2


def test_pairs_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for labels in (3, 20, 400):
        for g in range(12):
            base = [r.randrange(labels) for _ in range(r.randrange(1, 60))]
            for i in range(r.randrange(1, 5)):
                rows.append((f"{labels}-{g}-{i}", [v if r.random() > 0.3 else r.randrange(labels) for v in base for _ in range(r.randrange(1, 3))]))
    rows.append(("empty", []))
    seqs = spark.createDataFrame(rows, "key string, seq array<int>")
    want = brute(rows)
    for part in (7, 1024):
        assert {(x["a"], x["b"]): x["share"] for x in C.similar_pairs(seqs, part=part).collect()} == want
    x = [np.array(s) for _, s in rows if s]
    monkeypatch.setattr(C, "LABELS", 16)
    i, j = C.candidates(x, x, 0.65, 2.0)
    names = [k for k, s in rows if s]
    assert set(want) <= {(names[p], names[q]) for p, q in zip(i.tolist(), j.tolist())}
