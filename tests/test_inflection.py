from chronolex.operators import inflection as I

MORPH = [("dva", "dvě", "1", "fem", "pl"), ("dva", "dvou", "2", "fem", "pl"), ("pět", "pět", "1", "fem", "pl"), ("hodina", "hodiny", "1", "fem", "pl"), ("hodina", "hodin", "2", "fem", "pl"), ("minuta", "minuty", "1", "fem", "pl"), ("minuta", "minut", "2", "fem", "pl"), ("sto", "sto", "1", "fem", "pl")]


def test_forms_and_phrases(spark, got):
    m = spark.createDataFrame(MORPH, "lemma string, form string, cas string, gen string, num string")
    assert got(I.cardinal_forms(m, 2), "form") == [("dvou",), ("dvě",)]
    assert got(I.cardinal_forms(m, 102), "form") == [("sto dvou",), ("sto dvě",)]
    assert I.cardinal_forms(m, 7).collect() == []
    clock = {r["form"] for r in I.clock_phrases(m, 2, 5).collect()}
    assert {"dvě hodiny", "dvou hodin", "dvě hodiny pět minut"} <= clock
    assert got(I.clock_phrases(m, 5, 0), "form") == [("pět hodin",), ("pět hodiny",)]


def test_halves_quarters_ordinals_and_the_dial(spark, got):
    more = MORPH + [("hodina", "hodina", "1", "fem", "sing"), ("tři", "tři", "1", "fem", "pl"), ("třicet", "třicet", "1", "fem", "pl"), ("patnáct", "patnáct", "1", "fem", "pl")]
    m = spark.createDataFrame(more, "lemma string, form string, cas string, gen string, num string")
    half = {r["form"] for r in I.clock_phrases(m, 15, 30).collect()}
    assert {"půl čtvrté", "tři hodiny", "tři třicet", "patnáct třicet"} <= half
    assert {r["form"] for r in I.clock_phrases(m, 2, 0).collect()} >= {"druhá hodina", "dvě hodiny"}
    assert I.between_hours(12, 30) == ["půl jedné"] and I.between_hours(0, 15) == ["čtvrt na jednu"] and I.between_hours(13, 45) == ["tři čtvrtě na dvě", "tři čtvrti na dvě"]
    assert I.between_hours(5, 20) == []


def test_decimals(spark):
    rows = MORPH + [("celá", "celé", "1", "fem", "pl"), ("celá", "celých", "2", "fem", "pl"), ("desetina", "desetin", "1", "fem", "pl"), ("desetina", "desetin", "2", "fem", "pl"), ("nula", "nula", "1", "fem", "sing"), ("žádná", "žádná", "1", "fem", "sing")]
    m = spark.createDataFrame(rows, "lemma string, form string, cas string, gen string, num string")
    said = {r["form"] for r in I.decimal_phrases(m, 2, "5").collect()}
    assert {"dvě celé pět", "dvě celé pět desetin", "dvě a půl"} <= said
    none = {r["form"] for r in I.decimal_phrases(m, 0, "5").collect()}
    assert {"nula celých pět desetin", "žádná celých pět", "pět desetin", "nula a půl"} <= none
    assert I.decimal_phrases(m, 9, "9").collect() == []
