"""Speaker labels of many spellings to the speakers of a roster.

Distinct labels only are looked at. Blocking: the tokens of a label and the surnames of the
roster meet in a join on a phonetic code (consonant classes) and on that code less one symbol,
so one lost, doubled or swapped consonant still meets. Each pair that meets is costed by the
optimal assignment of the label's tokens to the name's parts. A label whose cheapest speakers
tie is decided per transcript, by a minimum-cost assignment in which speakers already named there
are cheaper and two labels do not share one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.shared import materialise

#: Classes of Czech consonants that sound alike once accents are gone.
SOUNDS = {"b": "p", "p": "p", "f": "f", "v": "f", "w": "f", "d": "t", "t": "t", "g": "k", "k": "k", "q": "k", "c": "s", "s": "s", "x": "s", "z": "s", "h": "h", "l": "l", "r": "r", "m": "m", "n": "n"}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Parameters of likeness. MOST: dearest pair that may name a speaker, in edits and parts of one. TIE: cheaper
#: differences are none. A surname of up to SHORT letters may differ by one edit, a longer one by two;
#: a given name of SPELT letters or more by one, a shorter one must be exact or an initial. A role is
#: known by its first ROLE letters.
MOST, TIE, SHORT, SPELT, ROLE = 2.0, 0.04, 5, 4, 5


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def name_tokens(label: str) -> list[str]:
    """Lower-case tokens without accents; camel case and punctuation part them."""
    return [t.lower() for t in _TOKEN.findall(plain(label))]


def _single(classes: str) -> str:
    """Neighbours of one class once."""
    return "".join(c for i, c in enumerate(classes) if i == 0 or c != classes[i - 1])


def sound(token: str) -> str:
    """Consonant classes in order, neighbours of one class once."""
    return _single("".join(SOUNDS.get(c, "") for c in token))


def block_keys(token: str) -> set[str]:
    """The token's code and the code less each one symbol, neighbours that then meet once."""
    code = sound(token)
    return {code} | {_single(code[:i] + code[i + 1 :]) for i in range(len(code))}


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        before, row = row, now
    return min(row[-1], most + 1)


def name_cost(tokens: list[str], given: str, surname: str, role: str) -> float:
    """Cheapest assignment of two of the tokens to given name and surname; infinite if none fits."""
    best = float("inf")
    bound = 1 if len(surname) <= SHORT else 2
    for i, t in enumerate(tokens):
        if len(t) < 2:
            continue
        far = edits(t, surname, bound)
        if far > bound:
            continue
        first = 0.6
        for j, g in enumerate(tokens):
            if j != i:
                if g == given:
                    first = 0.0
                elif len(g) == 1 and given.startswith(g):
                    first = min(first, 0.3)
                elif len(g) >= SPELT and edits(g, given, 1) == 1:
                    first = min(first, 0.5)
        best = min(best, far + first)
    if role and any(len(t) >= SPELT and t[:ROLE] == role[:ROLE] for t in tokens):
        best -= 0.05
    return best


def assign(costs: list[list[float]]) -> list[int]:
    """Column of each row in a minimum-cost assignment; rows may not outnumber columns."""
    n, m = len(costs), len(costs[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            delta, j1 = float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = costs[match[j0] - 1][j - 1] - u[match[j0]] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def candidates(labels: DataFrame, roster: DataFrame) -> DataFrame:
    """(label, speaker_id, cost) of the pairs within reach, from distinct labels and the roster."""

    def by_label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(x, k) for x in pdf["label"] for k in set().union(*(block_keys(t) for t in name_tokens(x) if len(t) > 1), set())]
            yield pd.DataFrame(rows, columns=["label", "block"])

    def by_name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, g, s, r in zip(pdf["speaker_id"], pdf["given_name"], pdf["surname"], pdf["role_name"]):
                names = ["".join(name_tokens(x or "")) for x in (g, s, r)]
                rows += [(i, *names, k) for k in block_keys(names[1]) if names[1]]
            yield pd.DataFrame(rows, columns=["speaker_id", "given", "surname", "role", "block"])

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = [name_cost(name_tokens(x), g, s, r) for x, g, s, r in zip(pdf["label"], pdf["given"], pdf["surname"], pdf["role"])]
            out = pdf[["label", "speaker_id"]].assign(cost=c)
            yield out[out["cost"] <= MOST]

    left = labels.mapInPandas(by_label, "label string, block string")
    right = roster.select(F.col("speaker_id").cast("int"), "given_name", "surname", "role_name").where("speaker_id is not null").mapInPandas(by_name, "speaker_id int, given string, surname string, role string, block string")
    return left.join(right, "block").drop("block").distinct().mapInPandas(cost, "label string, speaker_id int, cost double")


def resolve_labels(df: DataFrame, roster: DataFrame, *, transcript: Column, label: Column) -> DataFrame:
    """(transcript, label, speaker_id): the labels that name a speaker; the others have no row.

    ``transcript`` is null where the label means one speaker wherever it stands. Null, blank and
    unknown labels name nobody, and so do those that still tie within their transcript.
    """
    seen = df.select(transcript.cast("string").alias("transcript"), label.cast("string").alias("label")).where("label is not null").distinct()
    found = candidates(seen.select("label").distinct(), roster)
    w = Window.partitionBy("label")
    found = found.withColumn("least", F.min("cost").over(w)).where(F.col("cost") < F.col("least") + TIE)
    found = materialise(found.withColumn("ties", F.count("*").over(w)), "found")
    sure = found.where("ties = 1").select("label", "speaker_id")
    tied = found.where("ties > 1").select("label", "speaker_id", "cost")
    asked = seen.where("transcript is not null").join(tied, "label")
    there = seen.join(sure, "label").select("transcript", "speaker_id").distinct().withColumn("there", F.lit(True))
    asked = asked.join(there.join(asked.select("transcript").distinct(), "transcript", "left_semi"), ["transcript", "speaker_id"], "left")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        price = pdf.assign(c=pdf["cost"] - pdf["there"].eq(True)).pivot_table(index="label", columns="speaker_id", values="c", aggfunc="min")
        rows, cols = list(price.index), list(price.columns)
        table = [[float(c) if c == c else 50.0 for c in row] + [20.0] * len(rows) for row in price.to_numpy()]
        got = assign(table)
        out = []
        for i, x in enumerate(rows):
            mine = [c for c in table[i][: len(cols)] if c < 50]
            j = got[i]
            if j < len(cols) and sum(c <= table[i][j] + 1e-9 for c in mine) == 1:
                out.append((pdf["transcript"].iloc[0], x, int(cols[j])))
        return pd.DataFrame(out, columns=["transcript", "label", "speaker_id"])

    decided = asked.groupBy("transcript").applyInPandas(decide, "transcript string, label string, speaker_id int")
    return sure.select(F.lit(None).cast("string").alias("transcript"), "label", "speaker_id").unionByName(decided)
