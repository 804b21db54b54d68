from chronolex.functions.numerals import cardinal
from chronolex.plans import texts


def test_long_numbers_are_kept(spark, got, monkeypatch):
    numbers = ["7", "1234567890", "999999999999", "1000000000000", "9" * 25]
    text = " a ".join(numbers)
    monkeypatch.setattr(texts, "table", lambda s, d, name: spark.createDataFrame([("d", text)], "doc_id string, text string"))
    want = [("d", n, cardinal(int(n)) if int(n) < 10**12 else None) for n in numbers]
    assert got(texts.cardinal_words(spark, "")) == sorted(want, key=repr)
    monkeypatch.setattr(texts, "_transcripts", lambda s, d: spark.createDataFrame([("r", "s", text, "sedm")], "recording string, segment string, gold string, heard string"))
    out = {r["n"]: r["ranked"] for r in texts.rank_candidates(spark, "").collect()}
    assert set(out) == set(numbers) and out["7"][0] == "sedm" and out["1234567890"] is not None and out["9" * 25] is None
