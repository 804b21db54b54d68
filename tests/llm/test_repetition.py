import random
import re

import numpy as np
from pyspark.sql import functions as F

from chronolex.llm import repetition as R


def brute(words, k=5):
    seen, mark = set(), [False] * len(words)
    for i in range(len(words) - k + 1):
        g = tuple(words[i : i + k])
        if g in seen:
            mark[i : i + k] = [True] * k
        seen.add(g)
    return mark


def test_repeated_words_against_brute_force(monkeypatch):
    r = random.Random(3)
    for plain in (6000, 0):
        monkeypatch.setattr(R, "_PLAIN", plain)
        for n in (0, 1, 4, 5, 6, 60, 400):
            words = [f"w{r.randrange(4)}" for _ in range(n)]
            assert R.repeated(*R.numbered(words)).tolist() == brute(words)


def test_words_and_lines():
    words, starts = R.words_of("Za 61,6 milionu… A_b\n\nC? " + "x " * 45)
    assert words[:7] == ["za", "0", "0", "milionu", "a", "b", "c"] and starts == [0, 4, 6, 7, 27, 47]
    assert R.words_of(" .\n") == ([], [])
    assert R.words_of("é")[0] == R.words_of("É")[0]


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    for n in (1, 2, 6):
        x, w = r.random((n, len(R.FEATURES))), (r.normal(size=(2, len(R.FEATURES))), r.normal(size=(2, 2)))
        emit = x @ w[0].T
        score = lambda p: sum(emit[i, s] for i, s in enumerate(p)) + sum(w[1][a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(([int(c) for c in format(k, f"0{n}b")] for k in range(2**n)), key=score)
        assert R.viterbi(x, w).tolist() == best


def test_neighbours_change_an_answer_and_bars_hold():
    weak = np.array([[1.0, 1.0, 0, 1, 0], [1.0, 0.3, 0, 1, 0], [1.0, 1.0, 0, 1, 0]])
    free = (R.PRIOR[0], np.zeros((2, 2)))
    assert R.viterbi(weak, R.PRIOR).tolist() == [1, 1, 1] and R.viterbi(weak, free).tolist() == [1, 0, 1]
    clean = np.array([[1.0, 0, 0, 1, 0]] * 3)
    assert R.viterbi(clean, R.PRIOR, np.array([False, True, False])).tolist() == [0, 1, 0]
    assert R.viterbi(clean, R.PRIOR, np.zeros(3, bool)).tolist() == [0, 0, 0]


def test_three_words_heard_before():
    words = "a b c d a b c a b".split()
    assert np.flatnonzero(R.heard(*R.numbered(words))).tolist() == [4]
    assert not R.heard(np.array([0, 1]), 2).any()


def test_fit_raises_the_likelihood_and_survives_no_data():
    assert all((a == b).all() for a, b in zip(R.fit([]), R.PRIOR))
    r = np.random.default_rng(1)
    docs = []
    for _ in range(20):
        x = r.random((12, len(R.FEATURES)))
        docs.append((x, (x[:, 1] > 0.4).astype(int)))
    w = R.fit(docs)
    hits = np.mean([np.mean(R.viterbi(x, w) == y) for x, y in docs])
    assert hits > 0.85 and hits >= np.mean([np.mean(R.viterbi(x, R.PRIOR) == y) for x, y in docs])


def test_operator_over_any_text(spark):
    clean = " ".join(f"slovo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    spam = clean + ". " + "opakuje se to stále znovu a znovu. " * 40
    long = (clean + "\n") + " ".join(str(i) + "x" + chr(97 + i % 26) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " .\n?"), (4, clean), (5, spam), (6, "a " * 5000), (7, "slovo"), (8, long), (5, spam)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("key", F.lit("clash")).withColumn("words", F.lit(0))
    out = {r["key"]: r for r in R.repetition(df, key=F.col("id"), text=F.col("text")).collect()}
    for i in (1, 2, 3):
        assert (out[i]["words"], out[i]["lines"], out[i]["content_share"], out[i]["repeated_share"], out[i]["keep"]) == (0, 0, 1.0, 0.0, True)
    assert out[4]["keep"] and out[4]["repeated_share"] == 0 and out[4]["boilerplate_lines"] == 0
    w = re.findall(r"\w+", spam)
    assert abs(out[5]["repeated_share"] - np.mean(brute(w))) < 1e-12 and not out[5]["keep"] and out[5]["boilerplate_lines"] > 30
    assert out[6]["repeated_share"] > 0.99 and not out[6]["keep"]
    assert out[7]["keep"] and out[8]["words"] == 60_200
    assert R.repetition(df.limit(0), key=F.col("id"), text=F.col("text")).collect() == []
