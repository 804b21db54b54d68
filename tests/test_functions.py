import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.functions import align, audio, numerals, transcripts
from chronolex.functions import numeric as N
from chronolex.functions import text as T


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def test_text(value):
    assert value(T.find_times(F.lit("v 12.30 a 9.30"))) == ["12.30"]
    assert value(T.find_dates(F.lit("dne 5 . 3 . 2019"))) == ["5 3 2019"]
    assert value(T.find_dates(F.lit("dne 5 . 3 ."))) == ["5 3"] and value(T.find_dates(F.lit("41 . 3 ."))) == []
    assert value(T.find_month_dates(F.lit("23 . ledna"))) == ["23"] and value(T.find_month_dates(F.lit("1 . červen"))) == ["1"]
    assert value(T.replace_first(F.lit("aba"), F.lit("a"), F.lit("x"))) == "xba" and value(T.replace_first(F.lit("b"), F.lit("a"), F.lit("x"))) == "b"
    assert value(T.find_order(F.lit("a b a"), ["a", "a", "c"])) == [1, 5, 0]
    assert value(T.find_floats(F.lit("o 0 , 5 a 3 , 2 milionu za 7 , 1 x"), ["milionu"], ["za"])) == ["0 5", "3 2", "7 1"]
    assert value(T.find_floats(F.lit("1 , 5 x"), [], [])) == ["1 5"] and value(T.find_floats(F.lit("nic"), ["a"], ["b"])) == []
    assert value(T.strip_accents(F.lit("Příliš žluťoučký"))) == "Prilis zlutoucky"
    assert value(T.expand_words(F.lit("5 % tj x"), transcripts.ABBREVIATIONS)) == "5 procent to jest x"
    assert value(T.piece(F.lit("a/b"), 5)) is None and value(T.piece(F.lit("/x//y/"), -1)) == "y"
    pairs = F.array(F.struct(F.lit("1").alias("find"), F.lit("jedna").alias("by")), F.struct(F.lit("1").alias("find"), F.lit("dva").alias("by")))
    assert value(T.apply_replacements(F.lit("1 a 1"), pairs)) == "JEDNA a DVA"
    assert value(T.by_position(F.lit("x y z"), F.array(F.lit("z"), F.lit("x")))) == ["x", "z"]


def test_pad_in_group(spark, got):
    df = spark.createDataFrame([("A", 3), ("A", 12), ("A", 105), ("B", 1), ("B", 9)], "r string, i int")
    assert got(df.select("r", T.pad_in_group(F.col("i"), F.col("r")).alias("p"))) == [("A", "003"), ("A", "012"), ("A", "105"), ("B", "1"), ("B", "9")]


def test_numbers(value):
    rate = F.lit(16000.0)
    assert [value(N.frame_count(F.lit(n), rate)) for n in (16000, 8000, 400, 0)] == [49, 24, 1, -1]
    assert value(N.frame_count_stft(F.lit(9), F.lit(4))) == 5
    assert value(N.reflect_pad(F.sequence(F.lit(1), F.lit(9)), 2)) == [3, 2, *range(1, 10), 8, 7]
    assert value(N.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == 4
    assert [value(N.learning_rate(F.lit(e), 50.0, 0.1)) for e in (0, 4, 5, 49)] == [0, 0.8, 1, pytest.approx(1 / 45)]
    assert value(N.span_mask(F.lit(12), F.array(F.lit(2), F.lit(9)), 3)) == [2, 3, 4, 9, 10, 11]
    assert value(N.cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.lit(0))) == pytest.approx(math.log(2))
    assert value(N.argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))) == 1
    assert [value(N.clock_12h(F.lit(h))) for h in (0, 12, 13)] == [12, 12, 1]
    assert value(N.to_mono(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0))))) == [2.0, 4.0]
    starts = value(N.random_starts(F.lit(40), F.lit("k"), 0.2, 3))
    assert len(set(starts)) == 8 and max(starts) < 37 and value(N.random_starts(F.lit(2), F.lit("k"), 0.9, 3)) == []


def brute_global(a, b, gaps):
    """Best score over all alignments of short lists."""
    best = float("-inf")

    def go(i, j, score, last):
        nonlocal best
        if i == len(a) and j == len(b):
            best = max(best, score)
        if i < len(a) and j < len(b):
            go(i + 1, j + 1, score + align.likeness(a[i], b[j]), "")
        if i < len(a):
            go(i + 1, j, score + (gaps[1] if last == "b" else gaps[0]), "b")
        if j < len(b):
            go(i, j + 1, score + (gaps[1] if last == "a" else gaps[0]), "a")

    go(0, 0, 0.0, "")
    return best


def test_alignment():
    for a, b in (("dva tři", "dva čtyři tři"), ("x", "y z"), ("jedna a půl", "jedna půl"), ("", "a"), ("a b c d", "b d")):
        x, y = a.split(), b.split()
        score, pairs = align.align(x, y, align.GLOBAL, False)
        assert score == pytest.approx(brute_global(x, y, align.GLOBAL))
        assert [p for p, _ in pairs if p != "-"] == x and [q for _, q in pairs if q != "-"] == y
    score, pairs = align.align("dvacet pět".split(), "bylo jich dvacet pět lidí".split(), align.LOCAL, True)
    assert pairs == [("dvacet", "dvacet"), ("pět", "pět")] and score == 9
    assert align.evaluate([("-", "x"), ("ab", "ab"), ("cd", "-")]) == (2, 2.0, True, 1)


def test_numerals():
    assert [numerals.cardinal(n) for n in (0, 12, 21, 100, 245, 1000, 2001, 1_000_000, 5_300_002)] == [
        "nula", "dvanáct", "dvacet jedna", "sto", "dvě stě čtyřicet pět", "tisíc", "dva tisíce jedna", "milion", "pět milionů tři sta tisíc dva",
    ]
    assert "pětadvacet" in numerals.variants(25) and "pět a dvacet" in numerals.variants(25)
    assert "devatenáct set osmdesát devět" in numerals.variants(1989) and "dvacet čtrnáct" in numerals.variants(2014)
    assert numerals.leading_zeros("05") == ["nula pět", "pět"] and numerals.leading_zeros("00") == ["nula nula"]
    clock = {
        "12.45": ("dvanáct čtyřicet pět", "tří čtvrti na jednu", "dvanáct hodin čtyřicet pět minut"), "13.05": ("třináct nula pět", "třináct hodin nula pět minut", "třináct hodin pět minut"),
        "13.02": ("třináct dvě", "třináct hodin dvě minuty"), "14.02": ("čtrnáct hodin a dvě minuty",), "13.00": ("třináct nula nula", "jednu hodinu"), "14.00": ("dvě hodiny", "čtrnáct hodin"),
        "12.01": ("dvanáct hodin jedna minuta",), "12.30": ("půl jedné", "dvanáct třicet"), "17.30": ("půl šesté",), "11.15": ("čtvrt na dvanáct",),
    }
    assert all(set(said) <= set(numerals.time_variants(t)) for t, said in clock.items())
    decimals = {
        "0 , 0042": ("nula celá nula nula čtyřicet dva",), "9 , 209": ("devět celých dvěstě devět",), "0 , 1": ("jednu desetinu",), "0 , 3": ("žádná celá tři desetiny",), "1 , 4": ("jedna celá čtyři desetiny",),
        "80 , 4": ("osmdesát celých čtyři desetiny",), "1 , 5": ("jeden a půl",), "2 , 5": ("dva a půl", "dvě a půl"), "2 , 1": ("dvě celé jedna desetina",), "2 , 7": ("dvě celé sedm desetin",), "0 , 00103": ("nula celá nula nula sto tři",),
    }
    assert all(set(said) <= set(numerals.decimal_variants(t)) for t, said in decimals.items())
    assert numerals.time_variants("x") == [] and numerals.decimal_variants("x") == []
    assert [numerals.ordinal(n) for n in (1, 20, 34, 100, 215)] == ["první", "dvacátý", "třicátý čtvrtý", "stý", "dvoustý patnáctý"]
    with pytest.raises(ValueError):
        numerals.ordinal(1000)


def test_transcripts(value):
    assert transcripts.normalised("začátek v 12.30 hodin", "začátek ve dvanáct hodin třicet minut") == ["začátek v DVANÁCT HODIN TŘICET MINUT"]
    assert transcripts.normalised("má 25 lidí", "má pětadvacet lidí") == ["má PĚTADVACET lidí"]
    assert transcripts.normalised("Tj. 5", "xyz") == ["tj. 5"] and transcripts.normalised("Ahoj §", None) == ["ahoj paragraf"]
    assert value(transcripts.normalise_transcript(F.lit(None).cast("string"), F.lit("a"))) is None


def test_audio(value):
    wave = np.sin(np.arange(16000) * 0.2)
    x = audio.mfcc(wave, 16000)
    assert x.shape == (39, 51) and np.isfinite(x).all()
    assert np.abs(audio.differences(np.ones((2, 9)))).max() == 0 and np.allclose(audio.differences(np.arange(9.0)[None])[0, 2:-2], 1)
    assert audio.mfcc(np.zeros(1), 16000).shape == (39, 0)
    back = audio.resample(audio.resample(wave, 16000, 32000), 32000, 16000)
    assert np.abs(back - wave)[200:-200].max() < 0.02
    assert np.allclose(audio.cosine_basis(40, 40) @ audio.cosine_basis(40, 40).T, np.eye(40))


def test_ties_give_a_text_each_and_accents_may_go():
    # both readings of the year are heard in full and equally well
    assert transcripts.normalised("rok 1203 a 1203", "tisíc dvě stě tři dvanáct set tři") == [f"rok {w} a {w}" for w in ("TISÍC DVĚ STĚ TŘI",)]
    tied = align.best_ties([("a", 1.0), ("b", 1.0), ("c", 0.5)])
    assert tied == ["a", "b"]
    assert transcripts.normalised("Má 25 §", "pětadvacet", accents=False) == ["ma PETADVACET paragraf"]
    assert transcripts.normalised(None, "x") is None and transcripts.normalised("", None) == [""]


def test_ranking_keeps_more_for_repeats_and_prints():
    said = "pět pětadvacet dvacet pět"
    assert len(align.rank_candidates(["pět", "pětadvacet", "dvacet pět"], said, 1)) == 1
    assert len(align.rank_candidates(["pět", "pětadvacet", "dvacet pět"], said, 1, repeats=1)) == 2
    assert align.printed([("ano", "ano"), ("-", "xx"), ("ne", "-")]) == "ano -  ne\nano xx -"
    assert align.printed([]) == "\n"


def brute_floats(text, suffixes, prefixes):
    """The rules one by one, by plain searching."""
    import re

    rest, out = text.lower(), []
    for kind, s in [("zero", ""), *(("suffix", s) for s in suffixes), *(("prefix", p) for p in prefixes), ("start", "")]:
        pattern = {"zero": r"(?<=\s)0\s,\s\d+", "suffix": rf"\d+\s,\s\d+(?= {s})", "prefix": rf"(?<={re.escape(s)} )\d+\s,\s\d+", "start": r"^\d+\s,\s\d+"}[kind]
        for m in re.finditer(pattern, rest):
            out.append(m.group().replace(" , ", " "))
            whole = {"suffix": m.group() + " " + s, "prefix": s + " " + m.group()}.get(kind, m.group())
            rest = rest.replace(whole, "X" * len(whole), 1)
    return out


def test_floats_by_all_rules():
    r = np.random.default_rng(4)
    beside = ["kč", "do", "za", "kolem", "minus", "xyz", "procenta", "je"]
    suffixes, prefixes = [s for s in T.FLOAT_SUFFIXES if s in beside], [p for p in T.FLOAT_PREFIXES if p in beside]
    for _ in range(60):
        words = [str(r.choice(beside)) if r.random() < 0.6 else f"{r.integers(0, 3)} , {r.integers(0, 90)}" for _ in range(12)]
        text = " ".join(words)
        assert T.floats_in(text, suffixes, prefixes) == brute_floats(text, suffixes, prefixes)
    assert T.floats_in("3 , 5 mil . a 7 , 2 km za 1 , 1") == ["3 5", "7 2"] and T.floats_in("nic") == []


def test_expansions_and_inflected_ordinals():
    assert numerals.expansions(0) == ["nula"] and numerals.expansions(1_000) == ["tisíc"] and numerals.expansions(2_000_001) == ["dva miliony jedna"]
    assert {"pětadvacet tisíc jednaadvacet", "dvacet pět tisíc dvacet jedna"} <= set(numerals.expansions(25_021))
    assert "devatenáct set osmdesát devět" in numerals.expansions(1989) and "devětaosmdesát" not in " ".join(numerals.expansions(1989, inverted=False))
    with pytest.raises(ValueError):
        numerals.expansions(10**12)
    form = numerals.ordinal_form
    assert [form(34, 2, "fem", "sing"), form(2, 1, "masc_a", "pl"), form(1, 3, "neut", "sing"), form(4, 4, "masc_a", "sing"), form(4, 1, "masc_i", "pl")] == ["třicáté čtvrté", "druzí", "prvnímu", "čtvrtého", "čtvrté"]
    for n in range(1, 1000):
        assert form(n, 1, "masc_a", "sing") == form(n, 1, "masc_i", "sing") == numerals.ordinal(n)
