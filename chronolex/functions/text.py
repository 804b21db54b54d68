"""String and regular-expression functions on columns, built from JVM-side expressions but for ``find_floats``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The month names' beginnings by which a date is recognised.
MONTHS = ("led", "únor", "břez", "dub", "květ", "červ", "červen", "srp", "září", "říj", "listopad", "prosin")
#: Accented letters and what they are without accent.
ACCENTED = "áčďéěíňóřšťúůýžäöüľĺŕôàâçèêëîïñùûÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÄÖÜĽĹŔÔÀÂÇÈÊËÎÏÑÙÛ"
PLAIN = "acdeeinorstuuyzaoullroaaceeeiinuuACDEEINORSTUUYZAOULLROAACEEEIINUU"


def parts(path: Column) -> Column:
    """Pieces of a slash path without empty ones."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def piece(path: Column, index: int) -> Column:
    """The index-th piece from 1, or from the end with -1; null out of range."""
    return F.try_element_at(parts(path), F.lit(index))


def compose(*pieces: Column) -> Column:
    """Concatenation, null if any piece is."""
    return F.concat(*pieces)


def pad_in_group(index: Column, group: Column) -> Column:
    """The number with zeros to the width of the widest of its group."""
    text = index.cast("string")
    return F.lpad(text, F.max(F.length(text)).over(Window.partitionBy(group)), F.lit("0"))


def fixed_id(recording: Column) -> dict[str, Column]:
    """Date, start and end in a 16-digit id yyyyMMddHHmmHHmm."""
    s = lambda a, n: F.substring(recording, a, n)
    return {
        "day": F.concat(s(7, 2), F.lit("."), s(5, 2), F.lit("."), s(1, 4)),
        "start": F.concat(s(9, 2), F.lit(":"), s(11, 2)),
        "end": F.concat(s(13, 2), F.lit(":"), s(15, 2)),
    }


def trimmed_right(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def replace_first(text: Column, find: Column, by: Column) -> Column:
    """Only the first occurrence; unchanged without one."""
    at = F.instr(text, find)
    return F.when(at > 0, F.overlay(text, by, at, F.length(find))).otherwise(text)


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def expand_words(text: Column, table: dict[str, str]) -> Column:
    """Whole tokens replaced by the table."""
    m = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(m, t), t)), " ")


def has_digits(text: Column) -> Column:
    return text.rlike(r"\d")


def find_digits(text: Column) -> Column:
    """All runs of digits."""
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def find_hours(text: Column) -> Column:
    """Numbers followed by a form of the word for hours."""
    return F.regexp_extract_all(text, F.lit(r"(\d+) hodin[y]?"), F.lit(1))


def find_times(text: Column) -> Column:
    """Clock times of two and two digits, parted by a dot, with or without the word for hours."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+\.\d+)"), F.lit(1))
    return F.filter(found, lambda t: t.rlike(r"^\d{2}\.\d{2}$"))


def find_dates(text: Column) -> Column:
    """``d . m . [y]`` with spaces, as day month year parted by blanks; impossible ones left out."""
    found = F.regexp_extract_all(text, F.lit(r"\d+\s\.\s\d+\s\.\s*\d*"), F.lit(0))
    clean = F.transform(found, lambda d: F.trim(F.regexp_replace(F.replace(d, F.lit("."), F.lit(" ")), r"\s+", " ")))
    number = lambda d, i: F.coalesce(F.try_element_at(F.split(d, " "), F.lit(i)).try_cast("int"), F.lit(0))
    return F.filter(clean, lambda d: number(d, 1).between(1, 31) & number(d, 2).between(0, 12))


def find_month_dates(text: Column) -> Column:
    """Days before a month's name, each place once, in order of the text."""
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(\d+)\s?\.\s(?:{names})"), F.lit(1))


def digit_classes(text: Column) -> dict[str, Column]:
    """Whether a text holds dates, times and decimals."""
    return {
        "dates": (F.size(find_dates(text)) > 0) | (F.size(find_month_dates(text)) > 0),
        "times": F.size(find_times(text)) > 0,
        "floats": text.rlike(r"\d+\s?,\s?\d+"),
    }


#: What stands behind a decimal, and before one, in the order in which it is looked for.
FLOAT_SUFFIXES = (
    "řádku", "dny", "exekuce", "průměrné", "gramu", "GHz", "decibelu",
    "mld", "miliardy", "milionu", "mil .", "mil ", "%", "procentní",
    "tisíce", "stupně", "krát", "prac", "Kč", "promile", "metru",
    "tis ", "bili", "náso", "hod", "letech", "do", "desetinásobku",
    "bil ", "hrubé", "procenta", "roku", "HDP", "dne ", "miliony",
    "km", "miliony", "kilometru", "minuty", "měsíce", "měsících",
    "tuny", "miliarda", "koruny", "dítěte", "eura", "megawattu",
    "týdne", "za ", "až",
)
FLOAT_PREFIXES = (
    "deficit", "těch", "minus", "kolem", "výši", "nebo", "bude", "než",
    "ani", "plat", "nějaké", "úvazek", "nadýchal", "plnění", "hodnoty",
    "hranici", "mezi", "tam", "nad", "měli", " ze", "nejsou", "PM",
    "asi", "na", "být", "je", " na", " z", " od", " do", " mezi",
    "částkou", "současných", "tolerance", "činit", "růst", "krát",
    "koeficientu", "koeficientem", "koeficient", "koeficient na",
    "tempo", "průměrně", "plocha", "plus", "hodnotu", "násobku",
    "přebytek", "čísle", "komise", "průmysl", "Proč", "prostě",
    "rozpočtováno", "utraceno", "vybírám",
)


def floats_in(text: str, suffixes: Sequence[str] = FLOAT_SUFFIXES, prefixes: Sequence[str] = FLOAT_PREFIXES) -> list[str]:
    """Decimals ``w , d`` as ``w d``: leading zero, then before a suffix, after a prefix, at the start.

    Each hit is blanked, with its suffix or prefix, before the next rule looks.
    """
    rest, hits = text.lower(), []
    if not _FLOAT.search(rest):
        return hits
    rules = [("", _ZERO), *((s, _rule(f"({_FLOAT.pattern}) {s}")) for s in suffixes), *((p, _rule(f"{p} ({_FLOAT.pattern})")) for p in prefixes), ("", _FIRST)]
    for beside, rule in rules:
        if beside.split(".")[0] not in rest:
            continue
        for m in list(rule.finditer(rest)):
            hits.append(m.group(1))
            blank = m.group(1) if rule is _ZERO or rule is _FIRST else m.group()
            rest = rest.replace(blank, "X" * len(blank), 1)
    return [re.sub(r"\s,\s", " ", h) for h in hits]


@lru_cache(maxsize=1024)
def _rule(pattern: str) -> re.Pattern:
    return re.compile(pattern)


_FLOAT, _ZERO, _FIRST = (re.compile(p) for p in (r"\d+\s,\s\d+", r"\s(0\s,\s\d+)", r"^(\d+\s,\s\d+)"))


def find_floats(text: Column, suffixes: Sequence[str] = FLOAT_SUFFIXES, prefixes: Sequence[str] = FLOAT_PREFIXES) -> Column:
    """``floats_in`` over a column, in Arrow batches: a hundred ordered rules, each on what the ones before left."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else floats_in(t, suffixes, prefixes))

    return run(text)


def find_order(text: Column, items: list[str]) -> Column:
    """Positions (1-based, 0 if absent) of items looked for one after another, each hit blanked."""
    start = F.struct(text.alias("rest"), F.array().cast("array<int>").alias("at"))

    def apply(a: Column, item: Column) -> Column:
        blank = replace_first(a["rest"], item, F.repeat(F.lit("X"), F.length(item)))
        return F.struct(blank.alias("rest"), F.concat(a["at"], F.array(F.instr(a["rest"], item))).alias("at"))

    return F.aggregate(F.array(*map(F.lit, items)), start, apply)["at"]


def apply_replacements(text: Column, pairs: Column) -> Column:
    """Pairs (find, by) applied in order, each to its first occurrence, in capitals."""
    return F.aggregate(pairs, text, lambda t, p: replace_first(t, p["find"], F.upper(p["by"])))


def by_position(text: Column, items: Column) -> Column:
    """Items in order of where they stand in the text."""
    at = F.transform(items, lambda i: F.struct(F.instr(text, i).alias("at"), i.alias("item")))
    return F.transform(F.array_sort(at), lambda s: s["item"])


def tag_map(tag: Column) -> Column:
    """``A=x|B=y`` as a map."""
    return F.str_to_map(tag, F.lit(r"\|"), F.lit("="))
