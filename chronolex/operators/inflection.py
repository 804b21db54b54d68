"""Inflected number phrases over a morphology table (lemma, form, cas, gen, num) given as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions.numerals import ENDINGS, cardinal, ordinal_form
from chronolex.operators.relational import agreement_chain, union_all

TAG = ["cas", "gen"]


def _forms(morph: DataFrame, lemma: str) -> DataFrame:
    return morph.where(F.col("lemma") == lemma).select("form", "cas", "gen", "num")


def cardinal_forms(morph: DataFrame, n: int) -> DataFrame:
    """(cas, gen, num, form): the number with all its words inflected, or its last two digits only.

    Words agree in case and gender; a word the table lacks gives no form of the first kind, and
    none at all where it belongs to the last two digits.
    """
    words = cardinal(n).split()
    low = cardinal(n % 100).split() if n % 100 else words[-1:]
    every = agreement_chain([_forms(morph, w) for w in words], TAG).select(*TAG, "num", "form")
    head = words[: len(words) - len(low)]
    if not head:
        return every.distinct()
    tail = agreement_chain([_forms(morph, w) for w in low], TAG)
    return union_all(every, tail.select(*TAG, "num", F.concat(F.lit(" ".join(head) + " "), "form").alias("form"))).distinct()


def with_noun(numbers: DataFrame, nouns: DataFrame) -> DataFrame:
    """Numbers (cas, gen, num, form) with nouns that agree, and with the nouns' genitive of the gender."""
    n = numbers.select("cas", "gen", "num", F.col("form").alias("__n"))
    exact = n.join(nouns.select("cas", "gen", "num", "form"), ["cas", "gen", "num"])
    genitive = n.join(nouns.where("cas = '2'").select("gen", "form").distinct(), "gen")
    both = exact.select("cas", "gen", "num", "__n", "form").unionByName(genitive.select("cas", "gen", "num", "__n", "form"))
    return both.select("cas", "gen", "num", F.concat_ws(" ", "__n", "form").alias("form")).distinct()


def ordinal_forms(spark: SparkSession, n: int) -> DataFrame:
    """(cas, gen, num, form) of the ordinal: all cases, genders and numbers."""
    rows = [(str(case), g, m, ordinal_form(n, case, g, m)) for kind, g, m in ENDINGS if kind == "hard" for case in range(1, 8)]
    return spark.createDataFrame(rows, "cas string, gen string, num string, form string")


def clock_phrases(morph: DataFrame, hours: int, minutes: int, hour: str = "hodina", minute: str = "minuta") -> DataFrame:
    """(cas, form): every way to speak a time of day; the parts of a phrase are in one case.

    Hours alone and with minutes, both with their nouns; the two numbers without nouns; the hours of the
    afternoon on the dial of twelve too; full hours as an ordinal with the noun; halves to the next
    hour, and quarters after, half and to it, which do not decline (case 1).
    """
    spark = morph.sparkSession
    dials = [hours] + ([hours - 12] if hours > 12 else [12] if hours == 0 else [])
    parts = []
    for n in dials:
        bare = cardinal_forms(morph, n)
        h = with_noun(bare, _forms(morph, hour)).select("cas", F.col("form").alias("h")).distinct()
        parts.append(h.select("cas", F.col("h").alias("form")))
        if minutes:
            low = cardinal_forms(morph, minutes)
            m = with_noun(low, _forms(morph, minute)).select("cas", F.col("form").alias("m")).distinct()
            parts.append(h.join(m, "cas").select("cas", F.concat_ws(" ", "h", "m").alias("form")))
            short = bare.select("cas", F.col("form").alias("h")).distinct().join(low.select("cas", F.col("form").alias("m")).distinct(), "cas")
            parts.append(short.select("cas", F.concat_ws(" ", "h", "m").alias("form")))
        elif n:
            first = ordinal_forms(spark, n).where("gen = 'fem' and num = 'sing'").select("cas", F.col("form").alias("o"))
            noun = _forms(morph, hour).where("num = 'sing'").select("cas", F.col("form").alias("h"))
            parts.append(first.join(noun, "cas").select("cas", F.concat_ws(" ", "o", "h").alias("form")))
    fixed = between_hours(hours, minutes)
    if fixed:
        parts.append(spark.createDataFrame([("1", f) for f in fixed], "cas string, form string"))
    return union_all(*parts).distinct()


def between_hours(hours: int, minutes: int) -> list[str]:
    """Half and quarter hours, told by the hour that comes on the dial of twelve."""
    coming = hours % 12 + 1
    onto = {1: "jednu", 2: "dvě"}.get(coming, cardinal(coming))
    if minutes == 30:
        return ["půl " + (ordinal_form(coming, 2, "fem", "sing") if coming > 1 else "jedné")]
    return {15: [f"čtvrt na {onto}"], 45: [f"tři čtvrtě na {onto}", f"tři čtvrti na {onto}"]}.get(minutes, [])


def decimal_phrases(morph: DataFrame, whole: int, fraction: str, point: str = "celá", parts: tuple[str, ...] = ("desetina", "setina", "tisícina"), none: str = "žádná") -> DataFrame:
    """(cas, form): a decimal as number, point and number, with the name of its last place or without.

    All parts agree in case; a whole of 0 may also be ``none``; a fraction of 5 also gives "a půl".
    Only the parts whose words the table has take part. A fraction of more than three digits has
    no name of its place.
    """
    n, d = int(whole), int(fraction)
    head = cardinal_forms(morph, n)
    if n == 0:
        head = head.unionByName(_forms(morph, none).select("cas", "gen", "num", "form"))
    heads = with_noun(head, _forms(morph, point)).select("cas", F.col("form").alias("h")).distinct()
    low = cardinal_forms(morph, d)
    tails = [low.select("cas", F.col("form").alias("t"))]
    if len(fraction) <= len(parts):
        tails.append(with_noun(low, _forms(morph, parts[len(fraction) - 1])).select("cas", F.col("form").alias("t")))
    out = [heads.join(union_all(*tails).distinct(), "cas").select("cas", F.concat_ws(" ", "h", "t").alias("form"))]
    if n == 0 and len(tails) > 1:
        out.append(tails[1].select("cas", F.col("t").alias("form")))
    if d == 5 and len(fraction) == 1:
        out.append(head.select("cas", F.concat("form", F.lit(" a půl")).alias("form")))
    return union_all(*out).distinct()
