"""Word alignment with affine gaps and the ranking of rewritten transcripts by it.

Dynamic programmes over single rows; they run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "-"
LOCAL, GLOBAL = (-0.3, -0.1), (-0.9, -0.1)
Pairs = list[tuple[str, str]]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@lru_cache(maxsize=1 << 16)
def likeness(a: str, b: str) -> float:
    """Length of the longer word less the edit distance; words meet again and again, so it is kept."""
    return len(a) if a == b else max(len(a), len(b)) - levenshtein(a, b)


def align(a: list[str], b: list[str], gaps: tuple[float, float], local: bool, match: Callable[[str, str], float] = likeness) -> tuple[float, Pairs]:
    """Best score and its pairs; a gap of n costs open + (n - 1) * extend.

    Of equal ways, pairing comes before a gap in ``b``, and that before a gap in ``a``; a local
    alignment is the one that ends first.
    """
    low = float("-inf")
    start, extend = gaps
    n, m = len(a), len(b)
    pair = [[low] * (m + 1) for _ in range(n + 1)]  # ends in a pair
    skip = [[low] * (m + 1) for _ in range(n + 1)]  # ends in a gap in b
    leave = [[low] * (m + 1) for _ in range(n + 1)]  # ends in a gap in a
    pair[0][0] = 0.0
    if not local:
        for i in range(1, n + 1):
            skip[i][0] = start + (i - 1) * extend
        for j in range(1, m + 1):
            leave[0][j] = start + (j - 1) * extend
    top = (0.0, 0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            before = max(pair[i - 1][j - 1], skip[i - 1][j - 1], leave[i - 1][j - 1])
            pair[i][j] = match(a[i - 1], b[j - 1]) + (max(before, 0.0) if local else before)
            skip[i][j] = max(max(pair[i - 1][j], leave[i - 1][j]) + start, skip[i - 1][j] + extend)
            leave[i][j] = max(max(pair[i][j - 1], skip[i][j - 1]) + start, leave[i][j - 1] + extend)
            if pair[i][j] > top[0]:
                top = (pair[i][j], i, j)
    if local:
        score, i, j = top
        kind = 0
        if score <= 0:
            return 0.0, []
    else:
        i, j = n, m
        ends = (pair[i][j], skip[i][j], leave[i][j])
        score, kind = max(ends), max(range(3), key=lambda k: (ends[k], -k))
    out: Pairs = []
    close = lambda x, y: x == y or abs(x - y) < 1e-9
    while i > 0 or j > 0:
        if kind == 0:
            out.append((a[i - 1], b[j - 1]))
            rest = pair[i][j] - match(a[i - 1], b[j - 1])
            i, j = i - 1, j - 1
            if local and close(rest, 0.0):
                break
            kind = next((k for k, t in enumerate((pair, skip, leave)) if close(t[i][j], rest)), 0)
        elif kind == 1:
            out.append((a[i - 1], GAP))
            now = skip[i][j]
            i -= 1
            kind = next((k for k, v in ((0, pair[i][j] + start), (2, leave[i][j] + start), (1, skip[i][j] + extend)) if close(v, now)), 1)
        else:
            out.append((GAP, b[j - 1]))
            now = leave[i][j]
            j -= 1
            kind = next((k for k, v in ((0, pair[i][j] + start), (1, skip[i][j] + start), (2, leave[i][j] + extend)) if close(v, now)), 2)
    return score, out[::-1]


def evaluate(pairs: Pairs) -> tuple[int, float, bool, int]:
    """(total length, likeness, whether a replacement word met a gap, words aligned)."""
    total, score, count = 0, 0.0, 0
    for word, heard in pairs:
        if word == GAP:
            continue
        if heard == GAP:
            return total, score, True, count
        total += max(len(word), len(heard))
        score += likeness(word, heard)
        count += 1
    return total, score, False, count


def rank_candidates(candidates: list[str], heard: str, most: int | None, repeats: int = 0) -> list[tuple[str, float]]:
    """Candidates by likeness to what was heard, those with a gap left out; best first, ties in order.

    ``most`` and one more for each of ``repeats`` are kept; without ``most`` all are.
    """
    said = heard.split()
    out = []
    for c in candidates:
        words = c.split()
        _, pairs = align(words, said, LOCAL, True)
        total, score, gap, count = evaluate(pairs)
        if total and not gap and count == len(words):
            out.append((c, score / total + 0.02 * count))
    return sorted(out, key=lambda x: -x[1])[: None if most is None else most + repeats]


def best_ties(ranked: list[tuple[str, float]]) -> list[str]:
    """All candidates that share the best score."""
    return [c for c, score in ranked if score >= ranked[0][1] - 1e-9]


def printed(pairs: Pairs) -> str:
    """An alignment as two lines of columns, gaps as dashes."""
    width = [max(len(x), len(y)) for x, y in pairs]
    return "\n".join(" ".join(p[side].ljust(w) for p, w in zip(pairs, width)).rstrip() for side in (0, 1))


def alignment_text(a: Column, b: Column, local: bool) -> Column:
    """The best alignment of two texts' words as ``printed``; null where either is null."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else printed(align(s.split(), t.split(), LOCAL if local else GLOBAL, local)[1]) for s, t in zip(x, y)], dtype=object)

    return run(a, b)


def alignment_score(a: Column, b: Column, local: bool) -> Column:
    """Score of the best alignment of two texts' words; null where either is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else align(s.split(), t.split(), LOCAL if local else GLOBAL, local)[0] for s, t in zip(x, y)], dtype="float64")

    return run(a, b)


def ranked(candidates: Column, heard: Column, most: int, repeats: Column | None = None) -> Column:
    """``rank_candidates`` over columns: the best texts of an array, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or t is None else [w for w, _ in rank_candidates(list(c), t, most, int(k))] for c, t, k in zip(x, y, n)], dtype=object)

    return run(candidates, heard, F.lit(0) if repeats is None else repeats)
