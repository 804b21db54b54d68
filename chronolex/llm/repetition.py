"""Repetition inside single documents: problem 10.

A document is cut into lines (at line ends, sentence ends and after 20 words) and each line gets
a few features of how much of it has been heard before: three words in a row, the whole line, echoes. A
linear-chain conditional random field over the lines, decoded by Viterbi, marks them content or
boilerplate; the share of words on content lines decides whether the document is kept. A line with
a word in a repeated stretch of five may not be content: the decoder only looks at the paths
that respect this, so the field is never more lenient than the exact share. Between such lines it is
the field that decides, by features and neighbours. It is fitted here, on a bounded sample of
documents, towards a prior that holds where the sample says nothing; its labels are the stretches
of five, which are no feature. The exact share of words lying in a repeated stretch is measured
beside it, for every document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 5
LINE_WORDS = 20
_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"[\n\r\u2028\u2029.!?…]+")
_DIGITS = re.compile(r"\d+")
#: With fewer distinct words than this, five word numbers fit exactly into 63 bits.
_PLAIN = 6000

#: Prior weights: per state (content, boilerplate) over the features, then transitions[from, to].
FEATURES = ("bias", "three words heard before", "line stood before", "words", "echo of the last words")
PRIOR = (np.array([[1.0, -3.0, -1.0, 0.0, -1.0], [-1.0, 3.0, 1.0, 0.0, 1.0]]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def words_of(text: str) -> tuple[list[str], list[int]]:
    """Words without case, punctuation and the digits of numbers; where lines start among them."""
    text = _DIGITS.sub("0", unicodedata.normalize("NFC", text).casefold())
    words: list[str] = []
    starts: list[int] = []
    for line in _LINE.split(text):
        found = _WORD.findall(line)
        if found:
            starts.extend(range(len(words), len(words) + len(found), LINE_WORDS))
            words += found
    return words, starts


def numbered(words: list[str]) -> tuple[np.ndarray, int]:
    """Words as numbers, and how many there are."""
    at: dict[str, int] = {}
    return np.array([at.setdefault(w, len(at)) for w in words], np.int64), len(at)


def repeated(ids: np.ndarray, distinct: int, stretch: int = STRETCH) -> np.ndarray:
    """For each word, whether it lies in a stretch of ``stretch`` words that has stood earlier."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n <= stretch:
        return out
    gram, size = ids, distinct
    for k in range(1, stretch):
        gram = gram[: n - k] * size + ids[k:]
        if distinct >= _PLAIN:  # renumbered, pairs of numbers stay exact
            _, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    again = order[1:][gram[order[1:]] == gram[order[:-1]]]
    if len(again):
        for k in range(stretch):
            out[again + k] = True
    return out


def heard(ids: np.ndarray, distinct: int, few: int = 3) -> np.ndarray:
    """For each word, whether the ``few`` words from it on have stood so earlier."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n <= few:
        return out
    gram = ids
    for k in range(1, few):  # three numbers fit into 63 bits up to two million distinct words
        gram = gram[: n - k] * distinct + ids[k:]
        if distinct > 1 << 20:
            _, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    out[order[1:][gram[order[1:]] == gram[order[:-1]]]] = True
    return out


def line_features(ids: np.ndarray, starts: list[int], near: np.ndarray) -> np.ndarray:
    """(lines, features), all between 0 and 1, from word numbers, line starts and ``heard``."""
    begin = np.array(starts)
    end = np.append(begin[1:], len(ids))
    size = end - begin
    x = np.ones((len(begin), len(FEATURES)))
    x[:, 1] = np.add.reduceat(near.astype(float), begin) / size
    x[:, 3] = size / LINE_WORDS
    echo = np.zeros(len(ids))
    for lag in (1, 2, 3):
        echo[lag:] += ids[lag:] == ids[:-lag]
    x[:, 4] = np.add.reduceat(np.minimum(echo, 1), begin) / size
    seen: set[bytes] = set()
    for i, (a, b) in enumerate(zip(starts, end.tolist())):
        line = ids[a:b].tobytes()
        x[i, 2] = line in seen
        seen.add(line)
    return x


def viterbi(x: np.ndarray, weights: tuple[np.ndarray, np.ndarray], barred: np.ndarray | None = None) -> np.ndarray:
    """The likeliest state of each line, 1 for boilerplate; ``barred`` lines may not be content."""
    emit = x @ weights[0].T
    t = weights[1]
    if barred is not None and barred.any():
        emit[barred, 0] = -np.inf
    elif (emit[:, 0] >= emit[:, 1]).all() and t[0, 0] >= t.max():
        return np.zeros(len(x), np.int8)  # every step of the all-content path is the best there is
    emit = emit.tolist()
    (t00, t01), (t10, t11) = t.tolist()
    a, b = emit[0]
    back = []
    for to_a, to_b in emit[1:]:
        aa, ba, ab, bb = a + t00, b + t10, a + t01, b + t11
        back.append((ba > aa, bb > ab))
        a, b = (ba if ba > aa else aa) + to_a, (bb if bb > ab else ab) + to_b
    state = [int(b > a)]
    for step in reversed(back):
        state.append(int(step[state[-1]]))
    return np.array(state[::-1], np.int8)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5, pull: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of largest posterior: gradient ascent by forward-backward, pulled to the prior."""
    w, t = PRIOR[0].copy(), PRIOR[1].copy()
    docs = [(x, y) for x, y in docs if len(x)]
    lines = sum(len(x) for x, _ in docs)
    for _ in range(rounds if lines else 0):
        gw, gt = np.zeros_like(w), np.zeros_like(t)
        for x, y in docs:
            emit, n = x @ w.T, len(x)
            fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
            fore[0] = emit[0]
            for i in range(1, n):
                fore[i] = emit[i] + np.logaddexp(fore[i - 1, 0] + t[0], fore[i - 1, 1] + t[1])
                j = n - 1 - i
                after = aft[j + 1] + emit[j + 1]
                aft[j] = np.logaddexp(t[:, 0] + after[0], t[:, 1] + after[1])
            norm = np.logaddexp(*fore[-1])
            p = np.exp(fore + aft - norm)
            truth = np.eye(2)[y]
            gw += (truth - p).T @ x
            if n > 1:
                pair = np.exp(fore[:-1, :, None] + t + (emit + aft)[1:, None, :] - norm)
                gt += np.einsum("ni,nj->ij", truth[:-1], truth[1:]) - pair.sum(0)
        w += rate * (gw / lines - pull * (w - PRIOR[0]))
        t += rate * (gt / lines - pull * (t - PRIOR[1]))
    return w, t


def fit_on_sample(df: DataFrame, text: Column, documents: int = 150, lines: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted on at most ``documents`` documents, the first by a hash of the text.

    At most the first ``lines`` lines of each serve the fit. A line is boilerplate for it where at
    least half of its words lie in a repeated stretch of five, which no feature tells. Only features
    reach the driver.
    """
    x = df.select(text.alias("t")).where("t is not null").orderBy(F.xxhash64("t"), "t").limit(documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                words, starts = words_of(t)
                if words:
                    ids, distinct = numbered(words)
                    f = line_features(ids, starts, heard(ids, distinct))[:lines]
                    size = np.diff([*starts, len(ids)])
                    half = np.add.reduceat(repeated(ids, distinct).astype(float), starts) >= size / 2
                    rows.append((f.ravel().tolist(), half[:lines].astype(int).tolist()))
            yield pd.DataFrame(rows, columns=["x", "y"])

    got = x.mapInPandas(run, "x array<double>, y array<int>").collect()
    return fit([(np.array(r["x"]).reshape(-1, len(FEATURES)), np.array(r["y"])) for r in got])


def repetition(df: DataFrame, *, key: Column, text: Column, weights: tuple[np.ndarray, np.ndarray] | None = None, max_boilerplate: float = 0.35) -> DataFrame:
    """(key, words, lines, boilerplate_lines, content_share, repeated_share, keep) of each row.

    ``repeated_share`` is exact: the words in a stretch of five or more that has stood earlier in
    the text, over all words. ``content_share`` is the share of words on lines the field marks as
    content, at most 1 - ``repeated_share``; ``keep`` says that what is left is below
    ``max_boilerplate``. A null, empty or wordless text has no
    lines, shares 1 and 0, and is kept. Every row gives a row, repeated keys too; texts are read
    whole. An empty table gives an empty result; other columns play no part.
    """
    weights = weights or fit_on_sample(df, text)
    kind = df.select(key.alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                words, starts = words_of(t) if t is not None else ([], [])
                if not words:
                    rows.append((0, 0, 0, 1.0, 0.0, True))
                    continue
                ids, distinct = numbered(words)
                rep = repeated(ids, distinct)
                barred = np.logical_or.reduceat(rep, starts)
                state = viterbi(line_features(ids, starts, heard(ids, distinct)), weights, barred)
                marked = int(np.diff([*starts, len(ids)])[state == 1].sum())
                share = int(rep.sum()) / len(words)
                rows.append((len(words), len(starts), int(state.sum()), 1 - marked / len(words), share, marked / len(words) < max_boilerplate))
            out = pd.DataFrame(rows, columns=["words", "lines", "boilerplate_lines", "content_share", "repeated_share", "keep"])
            out.insert(0, "key", pdf["key"].to_numpy())
            yield out

    x = df.select(key.alias("key"), text.cast("string").alias("t"))
    return x.mapInPandas(run, f"key {kind}, words long, lines long, boilerplate_lines long, content_share double, repeated_share double, keep boolean")
