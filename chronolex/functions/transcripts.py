"""Transcripts normalised towards what was heard: digits written out the way they were spoken."""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolex.functions.align import best_ties, rank_candidates
from chronolex.functions.numerals import decimal_variants, time_variants, variants
from chronolex.functions.text import ACCENTED, PLAIN

#: Abbreviations and what they stand for.
ABBREVIATIONS = {
    "§": "paragraf", "č": "číslo", "mld": "miliarda", "%": "procent", "tj": "to jest", "sb": "sbírka", "cca": "cirka", "odst": "odstavec", "tzv": "takzvaně",
    "resp": "respektivě", "atd": "a tak dále", "hod": "hodin", "tzn": "to znamena", "apod": "a podobně", "kč": "korun", "/": "lomeno", "+": "plus", "09": "nula devět",
}
_CLOCK_WORD = re.compile(r"\d{1,2}\.\d{2} hod(?:in[y]?)?")
_CLOCK = re.compile(r"\d{1,2}\.\d{2}(?!\d)")
_HOURS = re.compile(r"\d+ hodin[y]?")
_DECIMAL = re.compile(r"\d+\s?,\s?\d+")
_PLAIN = re.compile(r"\d+")
_UNACCENTED = str.maketrans(ACCENTED, PLAIN)


def _spoken(hit: str) -> list[str]:
    if "." in hit:
        said = time_variants(re.sub(r" hod(in[y]?)?$", "", hit))
        return said if " hod" not in hit else [*said, *(f"{s} hodin" for s in said if "hodin" not in s)]
    if "," in hit:
        return decimal_variants(hit)
    number = int(_PLAIN.match(hit).group())
    if number >= 10**12:
        return []
    words = variants(number) + (variants(number % 12) if " hodin" in hit and number > 12 else [])
    return [f"{w} hodin" for w in words] if " hodin" in hit else words


def number_hits(text: str) -> list[tuple[int, int]]:
    """Where the numbers of a text stand, in order.

    Clock times with a unit come first, then bare ones, hours, decimals and plain numbers; a hit is
    masked before the next family looks.
    """
    rest, hits = text, []
    for family in (_CLOCK_WORD, _CLOCK, _HOURS, _DECIMAL, _PLAIN):
        hits += [m.span() for m in family.finditer(rest)]
        rest = family.sub(lambda m: "X" * len(m.group()), rest)
    return sorted(hits)


def expand_digits(text: str, heard: str) -> list[str]:
    """The text with each number replaced by the spoken form nearest to what was heard, in capitals.

    Forms that share the best score each give a text, so ties of several numbers multiply. Equal
    numbers are ranked once. A number none of whose forms is heard stays as it is.
    """
    hits = number_hits(text)
    forms: dict[str, list[str]] = {}
    for a, b in hits:
        if text[a:b] not in forms:
            forms[text[a:b]] = [w.upper() for w in best_ties(rank_candidates(_spoken(text[a:b]), heard, None))] or [text[a:b]]
    between = [text[a:b] for a, b in zip([0, *(b for _, b in hits)], [*(a for a, _ in hits), len(text)])]
    out = []
    for chosen in product(*(forms[text[a:b]] for a, b in hits)):
        out.append("".join(x for pair in zip(between, chosen) for x in pair) + between[-1])
    return list(dict.fromkeys(out))


def normalised(text: str | None, heard: str | None, accents: bool = True) -> list[str] | None:
    """Lower case, abbreviations and digits written out; without accents where they are not wanted."""
    if text is None:
        return None
    words = " ".join(ABBREVIATIONS.get(t, t) for t in text.lower().split(" "))
    out = expand_digits(words, (heard or "").lower()) if _PLAIN.search(words) else [words]
    return out if accents else [t.translate(_UNACCENTED) for t in out]


def normalise_transcript(text: Column, heard: Column, accents: bool = True) -> Column:
    """``normalised`` over a column, in Arrow batches: an array of texts; null texts stay null."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([normalised(a, b, accents) for a, b in zip(x, y)], dtype=object)

    return run(text, heard)
