"""Czech number words: cardinals, their spoken variants, clock times, decimals, ordinals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the language.
ONES = ("nula", "jedna", "dva", "tři", "čtyři", "pět", "šest", "sedm", "osm", "devět", "deset", "jedenáct", "dvanáct", "třináct", "čtrnáct", "patnáct", "šestnáct", "sedmnáct", "osmnáct", "devatenáct")
TENS = ("", "", "dvacet", "třicet", "čtyřicet", "padesát", "šedesát", "sedmdesát", "osmdesát", "devadesát")
HUNDREDS = ("", "sto", "dvě stě", "tři sta", "čtyři sta", "pět set", "šest set", "sedm set", "osm set", "devět set")
SCALES = ((10**9, "miliarda", "miliardy", "miliard", "fem"), (10**6, "milion", "miliony", "milionů", "masc"), (10**3, "tisíc", "tisíce", "tisíc", "masc"))
ORDINAL_ONES = ("", "první", "druhý", "třetí", "čtvrtý", "pátý", "šestý", "sedmý", "osmý", "devátý", "desátý", "jedenáctý", "dvanáctý", "třináctý", "čtrnáctý", "patnáctý", "šestnáctý", "sedmnáctý", "osmnáctý", "devatenáctý")
ORDINAL_TENS = ("", "", "dvacátý", "třicátý", "čtyřicátý", "padesátý", "šedesátý", "sedmdesátý", "osmdesátý", "devadesátý")
ORDINAL_HUNDREDS = ("", "stý", "dvoustý", "třístý", "čtyřstý", "pětistý", "šestistý", "sedmistý", "osmistý", "devítistý")
HOURS_OF = ("", "jedné", "druhé", "třetí", "čtvrté", "páté", "šesté", "sedmé", "osmé", "deváté", "desáté", "jedenácté", "dvanácté")
LINKERS = ("celé", "celých", "celá", "celý")
HOUR, MINUTE = ("hodina", "hodiny", "hodin"), ("minuta", "minuty", "minut")
TENTHS = {1: ("desetina", "desetiny", "desetin"), 2: ("setina", "setiny", "setin"), 3: ("tisícina", "tisíciny", "tisícin")}


def _below_thousand(n: int, gender: str = "") -> list[str]:
    out = [HUNDREDS[n // 100]] if n >= 100 else []
    n %= 100
    if n >= 20:
        out.append(TENS[n // 10])
        n %= 10
    if n:
        word = ONES[n]
        if n == 1 and gender == "masc":
            word = "jeden"
        if n == 2 and gender == "fem":
            word = "dvě"
        out.append(word)
    return out


def cardinal(n: int) -> str:
    """The number in words, up to 10**12 - 1; negative ones after minus."""
    if n < 0:
        return "minus " + cardinal(-n)
    if n == 0:
        return ONES[0]
    if n >= 10**12:
        raise ValueError(f"{n} is too large for words")
    out: list[str] = []
    for size, one, few, many, gender in SCALES:
        k, n = divmod(n, size)
        if k:
            if k > 1:
                out += _below_thousand(k, gender)
            out.append(one if k == 1 else few if k in (2, 3, 4) else many)
    return " ".join(out + _below_thousand(n))


def inverted_tens(n: int) -> list[str]:
    """The ones before the tens, as one word and as three; none for round tens and below 21."""
    tens, ones = divmod(n % 100, 10)
    if tens < 2 or ones == 0:
        return []
    return [ONES[ones] + link + TENS[tens] for link in ("a", " a ")]


@dataclass(frozen=True)
class Reading:
    """One way to speak a number: the words of all but its last two digits, then those two.

    ``head`` gives the words from the hundreds; ``spoken`` says of which numbers the way is used;
    ``bare`` that it also stands without last digits; ``turned`` that they may be turned around and
    ``straight`` that they may be spoken in order.
    """

    head: Callable[[int], str]
    spoken: Callable[[int], bool]
    bare: bool = True
    straight: bool = True
    turned: bool = True

    def of(self, n: int) -> list[str]:
        hundreds, last = divmod(n, 100)
        if not self.spoken(n):
            return []
        if last == 0:
            ends = [""] if self.bare else []
        else:
            ends = ([cardinal(last)] if self.straight else []) + (inverted_tens(last) if self.turned else [])
        return [" ".join(w for w in (self.head(hundreds), end) if w) for end in ends]


#: The ways of Czech: the number as written; hundreds counted up to nineteen of them; digits in pairs.
READINGS = (
    Reading(lambda h: cardinal(h * 100) if h else "", lambda n: n > 0),
    Reading(lambda h: f"{cardinal(h)} set", lambda n: n // 100 in range(11, 20)),
    Reading(cardinal, lambda n: n // 1000 in range(1, 10), bare=False, turned=False),
)


def variants(n: int) -> list[str]:
    """Spoken variants of a number, distinct, the plain one first."""
    return _distinct([cardinal(n), *(words for way in READINGS for words in way.of(n))])


def leading_zeros(digits: str) -> list[str]:
    """A number with leading zeros, each zero spoken, or all of them dropped."""
    rest = digits.lstrip("0")
    zeros = [ONES[0]] * (len(digits) - len(rest))
    if not rest:
        return [" ".join(zeros)]
    return [" ".join([*zeros, cardinal(int(rest))]), cardinal(int(rest))]


def feminine(n: int) -> str:
    """The number as it stands before a feminine noun."""
    words = cardinal(n)
    return words[:-3] + "dvě" if words.endswith("dva") else words


def counted(n: int, noun: tuple[str, str, str]) -> str:
    """The form of a noun that goes with the number."""
    return noun[0] if n == 1 else noun[1] if n in (2, 3, 4) else noun[2]


def joined_hundreds(words: str) -> str:
    """Hundreds as one word."""
    for h in HUNDREDS[2:]:
        words = words.replace(h, h.replace(" ", ""))
    return words


def _distinct(texts: list[str]) -> list[str]:
    return list(dict.fromkeys(texts))


def decimal_variants(text: str) -> list[str]:
    """``w , d`` as whole, linker and fraction, all combinations; nothing for other texts."""
    whole, _, fraction = text.replace(" ", "").partition(",")
    if not whole.isdigit() or not fraction.isdigit() or len(whole) > 12 or len(fraction) > 12:
        return []
    n, d = int(whole), int(fraction)
    heads = [cardinal(n), feminine(n)] + {0: ["žádná"], 1: ["jeden"]}.get(n, [])
    tails = leading_zeros(fraction) if fraction.startswith("0") else [*variants(d), feminine(d)]
    units = ("", counted(d, TENTHS[len(fraction)])) if len(fraction) in TENTHS else ("",)
    out = [" ".join(w for w in p if w) for p in product(_distinct(heads), (*LINKERS, ""), _distinct(tails), units)]
    if fraction in ("5", "50"):
        out += [f"{h} a půl" for h in heads]
    if not n and len(units) == 2:
        out.append("jednu " + units[1][:-1] + "u" if d == 1 else f"{feminine(d)} {units[1]}")
    return _distinct([w for o in out for w in (o, joined_hundreds(o))])


def time_variants(text: str) -> list[str]:
    """``hh.mm`` as it may be spoken: 24 or 12 hours, with or without units, halves and quarters."""
    hours, _, minutes = text.replace("hodin", "").replace(" ", "").partition(".")
    if not hours.isdigit() or not minutes.isdigit() or len(hours) > 2 or len(minutes) > 2:
        return []
    h, m = int(hours), int(minutes)
    heads = [(cardinal(h), h), (feminine(h), h), *((x, h) for x in inverted_tens(h))]
    heads += [(w, h % 12) for w in (cardinal(h % 12), feminine(h % 12))] if h > 12 else []
    heads += [(w, h) for w in leading_zeros(hours)] if hours.startswith("0") else []
    tails = [cardinal(m), feminine(m), *inverted_tens(m), *(leading_zeros(minutes) if minutes.startswith("0") else [])]
    out = []
    for head, n in heads:
        out += [head, f"{head} hodin", f"{head} {counted(n, HOUR)}"]
        for tail in _distinct(tails):
            out += [f"{head} {tail}", f"{head} {tail} hodin"]
            out += [f"{head} {hour} {link}{tail}{unit}" for hour in ("hodin", counted(n, HOUR)) for link in ("", "a ") for unit in ("", " minut", " " + counted(m, MINUTE))]
    coming = h % 12 + 1
    onto = {1: "jednu", 2: "dvě"}
    if m == 0 and h % 12 == 1:
        out.append("jednu hodinu")
    if m == 30:
        out += [f"půl {cardinal(coming)}", f"půl {HOURS_OF[coming]}"]
    if m == 15:
        out.append(f"čtvrt na {onto.get(coming, cardinal(coming))}")
    if m == 45:
        out += [f"{three} na {onto.get(coming, cardinal(coming))}" for three in ("tři čtvrtě", "tři čtvrti", "tří čtvrti")]
    return _distinct(out)


def ordinal(n: int) -> str:
    """Ordinal below 1000."""
    if not 0 < n < 1000:
        raise ValueError(f"no ordinal of {n}")
    out = [ORDINAL_HUNDREDS[n // 100]] if n >= 100 else []
    n %= 100
    if n >= 20:
        out.append(ORDINAL_TENS[n // 10])
        n %= 10
    if n:
        out.append(ORDINAL_ONES[n])
    return " ".join(out)


#: Fixed values of the language: endings of hard (-ý) and soft (-í) adjectives, by gender and number over the
#: cases 1 to 7; masculine nouns are animate or not.
ENDINGS = {
    ("hard", "masc_a", "sing"): ("ý", "ého", "ému", "ého", "ý", "ém", "ým"),
    ("hard", "masc_i", "sing"): ("ý", "ého", "ému", "ý", "ý", "ém", "ým"),
    ("hard", "fem", "sing"): ("á", "é", "é", "ou", "á", "é", "ou"),
    ("hard", "neut", "sing"): ("é", "ého", "ému", "é", "é", "ém", "ým"),
    ("hard", "masc_a", "pl"): ("í", "ých", "ým", "é", "í", "ých", "ými"),
    ("hard", "masc_i", "pl"): ("é", "ých", "ým", "é", "é", "ých", "ými"),
    ("hard", "fem", "pl"): ("é", "ých", "ým", "é", "é", "ých", "ými"),
    ("hard", "neut", "pl"): ("á", "ých", "ým", "á", "á", "ých", "ými"),
    ("soft", "masc_a", "sing"): ("í", "ího", "ímu", "ího", "í", "ím", "ím"),
    ("soft", "masc_i", "sing"): ("í", "ího", "ímu", "í", "í", "ím", "ím"),
    ("soft", "fem", "sing"): ("í", "í", "í", "í", "í", "í", "í"),
    ("soft", "neut", "sing"): ("í", "ího", "ímu", "í", "í", "ím", "ím"),
    ("soft", "masc_a", "pl"): ("í", "ích", "ím", "í", "í", "ích", "ími"),
    ("soft", "masc_i", "pl"): ("í", "ích", "ím", "í", "í", "ích", "ími"),
    ("soft", "fem", "pl"): ("í", "ích", "ím", "í", "í", "ích", "ími"),
    ("soft", "neut", "pl"): ("í", "ích", "ím", "í", "í", "ích", "ími"),
}


def ordinal_form(n: int, case: int, gender: str, number: str) -> str:
    """The ordinal in a case 1 to 7, a gender and a number: all its words decline."""
    out = []
    for word in ordinal(n).split():
        kind = "hard" if word.endswith("ý") else "soft"
        ending = ENDINGS[kind, gender, number][case - 1]
        stem = word[:-1]
        if kind == "hard" and ending == "í":  # softened before the ending of animate nominatives
            stem = stem[:-1] + "ř" if stem.endswith("r") else stem[:-1] + "z" if stem.endswith("h") else stem
        out.append(stem + ending)
    return " ".join(out)


def groups(n: int) -> list[tuple[int, str]]:
    """The number cut in threes from the front: (count, form of the scale); the units have no form."""
    if not 0 <= n < 10**12:
        raise ValueError(f"{n} is too large for words")
    out = []
    for size, one, few, many, _ in SCALES:
        k, n = divmod(n, size)
        if k:
            out.append((k, counted(k, (one, few, many))))
    return [*out, (n, "")] if n or not out else out


def expansions(n: int, inverted: bool = True) -> list[str]:
    """All ways to speak a number group by group, the groups combined; the plain one first.

    Each group may turn its last two digits around; 1100 to 1999 may count hundreds. A single
    thousand, million or milliard is its form alone, "jedna" takes the gender of the form, and two of a
    feminine one are "dvě".
    """
    gender = {many: g for _, _, _, many, g in SCALES} | {few: g for _, _, few, _, g in SCALES} | {one: g for _, one, _, _, g in SCALES}
    parts = []
    for k, form in groups(n):
        plain = cardinal(k) if not form else " ".join(_below_thousand(k, gender[form])) if k > 1 else ""
        turned = [f"{cardinal(k - k % 100)} {t}" if k >= 100 else t for t in inverted_tens(k)] if inverted else []
        parts.append(_distinct([" ".join(w for w in (p, form) if w) for p in (plain, *turned)]))
    out = [" ".join(p) for p in product(*parts)]
    return _distinct([cardinal(n), *out, *(READINGS[1].of(n) if inverted else READINGS[1].of(n)[:1])])


def _arrow(f, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else f(v))

    return run


def cardinal_words(n: Column) -> Column:
    """Number words of a long column."""
    return _arrow(lambda v: cardinal(int(v)), "string")(n)


def number_variants(n: Column) -> Column:
    return _arrow(lambda v: variants(int(v)), "array<string>")(n)


def number_expansions(n: Column) -> Column:
    return _arrow(lambda v: expansions(int(v)), "array<string>")(n)


def ordinal_words(n: Column) -> Column:
    """Ordinals of a column; null outside 1 to 999."""
    return _arrow(lambda v: ordinal(int(v)) if 0 < v < 1000 else None, "string")(n)


def ordinal_paradigm(n: Column) -> Column:
    """All forms of an ordinal as an array of (cas, gen, num, form)."""

    @F.pandas_udf("array<struct<cas:string,gen:string,num:string,form:string>>")
    def run(x: pd.Series) -> pd.Series:
        places = [(c, g, m) for kind, g, m in ENDINGS if kind == "hard" for c in range(1, 8)]
        return x.map(lambda v: None if v is None or v != v else [{"cas": str(c), "gen": g, "num": m, "form": ordinal_form(int(v), c, g, m)} for c, g, m in places])

    return run(n)


def spoken_times(text: Column) -> Column:
    return _arrow(time_variants, "array<string>")(text)


def spoken_decimals(text: Column) -> Column:
    return _arrow(decimal_variants, "array<string>")(text)
