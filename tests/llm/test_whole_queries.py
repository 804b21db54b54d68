import random

from pyspark.sql import functions as F

from chronolex.llm import queries as Q
from chronolex.llm import repetition


def tables(spark, monkeypatch, rows, schema):
    monkeypatch.setattr(Q, "table", lambda s, d, name: spark.createDataFrame(rows, schema))


def test_repeats_spread_over_lines(spark, got, monkeypatch):
    """Lines of 20 words of which 12 repeat, each followed by 5 new words: 0.46 repeated."""
    r = random.Random(2)
    new = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(n))
    said = new(12)
    spread = "\n".join(f"{said} {new(8)}\n{new(5)}" for _ in range(30))
    docs = [("spread", spread)] + [(f"clean{i}", "\n".join(new(9) for _ in range(40))) for i in range(60)]
    tables(spark, monkeypatch, docs, "doc_id string, text string")
    assert got(Q.p10_found(spark, "")) == [("spread",)]
    row = Q.p10_shares(spark, "").where("doc_id = 'spread'").first()
    assert row["boilerplate_lines"] >= 29 and row["content_share"] <= 1 - row["repeated_share"]


def test_components_of_a_side_are_counted(spark, monkeypatch):
    """More components than an approximate count gets right."""
    split = spark.range(30000).select(F.col("id").cast("string").alias("recording"), F.col("id").cast("double").alias("segment_index__segments"), (F.col("id") / 2).cast("long").alias("component"), F.when(F.col("id") < 20000, "train").otherwise("dev").alias("side"))
    monkeypatch.setattr(Q, "_split", lambda s, d: split)
    tables(spark, monkeypatch, [("train", 0.9), ("dev", 0.1)], "side string, target_share double")
    out = {x["side"]: (x["segments"], x["components"]) for x in Q.p3_sides(spark, "").collect()}
    assert out == {"train": (20000, 10000), "dev": (10000, 5000)}


def test_the_field_decides_and_the_exact_share_only_checks(spark, got, monkeypatch):
    """Words that come again in fours: the field calls them boilerplate, but no stretch of five repeats."""
    r = random.Random(3)
    new = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(n))
    fours = [new(4) for _ in range(4)]
    near = "\n".join(" ".join(f"{r.choice(fours)} {new(1)}" for _ in range(3)) for _ in range(40))
    same = "\n".join([new(10)] * 20)
    monkeypatch.setattr(repetition, "fit_on_sample", lambda *a, **more: repetition.PRIOR)
    tables(spark, monkeypatch, [("near", near), ("same", same)] + [(f"clean{i}", "\n".join(new(9) for _ in range(40))) for i in range(60)], "doc_id string, text string")
    x = {row["doc_id"]: row for row in Q.p10_shares(spark, "").collect()}
    assert not x["near"]["keep"] and x["near"]["repeated_share"] < 0.35 and not x["same"]["keep"]
    assert all(row["keep"] for k, row in x.items() if k.startswith("clean"))
    assert got(Q.p10_found(spark, "")) == [("same",)]


def test_shortness_comes_from_the_schedule(spark, got, monkeypatch):
    """Sources whose blocks run out are short; one that is a hair over its target is not."""
    docs = [(i, s, n) for i, (s, n) in enumerate([("a", 400)] * 300 + [("b", 400)] * 100 + [("c", 380)] * 5)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    total = sum(n for _, _, n in docs)
    targets = [("a", 0.45, 1), ("b", 80_000 / total - 1e-9, 2), ("c", 0.55 - 80_000 / total, 3)]
    monkeypatch.setattr(Q, "_sized", lambda s, d: sized)
    monkeypatch.setattr(Q, "table", lambda s, d, name: spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    assert got(Q.p9_found(spark, "")) == [("c",)]
    plan = Q.p9_found(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "slot#" in plan and "/mixture-" in "".join(Q.p9_found(spark, "").inputFiles())
