import random

import numpy as np

from chronolex.llm import clusters as C


def shuffled(spark):
    """Bytes this session has written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_shuffle_grows_with_the_records_not_with_the_pairs_of_blocks(spark):
    r = random.Random(4)
    rows = [(f"k{i:04d}", [r.randrange(1000) for _ in range(100)]) for i in range(480)]
    rows += [(f"twin{i}", rows[i][1]) for i in range(0, 480, 40)]
    want = {(f"k{i:04d}", f"twin{i}") for i in range(0, 480, 40)}
    took = []
    for some in (rows[-123:], rows):
        seqs = spark.createDataFrame(some, "key string, seq array<int>")
        began = shuffled(spark)
        found = {(x["a"], x["b"]) for x in C.similar_pairs(seqs, part=6).collect()}
        took.append(shuffled(spark) - began)
    assert found == want
    assert took[1] < 6 * took[0]  # four times the records; sixteen times the pairs of blocks


def test_counts_beyond_any_level_and_labels_apart():
    x = [[1] * 40 + [2] * 5, [3] * 9]
    y = [[1] * 40 + [5] * 20, [3] * 5 + [4] * 5, [7] * 9]
    i, j = C.candidates(*([np.array(v) for v in s] for s in (x, y)), 0.65, 2.0)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0)]
