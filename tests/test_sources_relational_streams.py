import pytest
from pyspark.sql import functions as F

from chronolex.operators import frames
from chronolex.operators import relational as R
from chronolex.sources import delimited as D
from chronolex.streaming import windows


def test_scans(spark, tmp_path, got):
    (tmp_path / "w.tsv").write_text('"ano\tw1\t1.0\t2.0\t-\t0.1\tA "B"\n')
    assert D.scan_words(spark, str(tmp_path / "w.tsv")).first()["word"] == '"ano'
    assert D.quote_safe_scan(spark, str(tmp_path / "w.tsv"), D.WORDS).first()["speaker"] == "A <quote>B<quote>"
    (tmp_path / "a.tsv").write_text("h\n" + "\t".join(["x", "-", "True", "id", "False", "-", "1", "2", "3", "4", "5"]) + "\n")
    row = D.scan_aligned(spark, str(tmp_path / "a.tsv")).first()
    assert row["trans_w"] == "-" and row["dist"] is None and row["joined"] is True
    for name, text in (("1.csv", "a,b\n1,x\n2,y\n"), ("2.csv", "a,b,c\n1,x,z\n"), ("3.csv", "a,b\n3,z\n"), ("skip.txt", "no")):
        (tmp_path / name).write_text(text)
    rows, bad = D.scan_validated(spark, str(tmp_path), "a int, b string")
    assert got(rows) == [(1, "x"), (2, "y"), (3, "z")] and [r["columns"] for r in bad.collect()] == [3]
    assert got(D.scan(spark, str(tmp_path), "a int, b string", only="1.csv")) == [(1, "x"), (2, "y")]
    texts = D.whole_texts(spark, str(tmp_path), "skip*").collect()
    assert [r["text"] for r in texts] == ["no"]
    assert spark.range(1).select(D.parse_list(F.lit("['a', 'b']"))).first()[0] == ["a", "b"]


def test_sinks(spark, tmp_path, got):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 1)], "k string, v int, bucket int")
    D.write_delimited(df, str(tmp_path / "csv"), "\t")
    assert got(D.scan(spark, str(tmp_path / "csv"), "k string, v int, bucket int", "\t")) == got(df)
    assert D.bucketed_write(df, str(tmp_path / "b"), "bucket", ["k"]) == {"only_left": 0, "only_right": 0, "both": 3}
    D.write_chunks(spark.range(10).coalesce(1), str(tmp_path / "c"), 4)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3
    both = D.first_available(df.where("v < 3"), df.withColumn("v", F.col("v") * 10), "k", "v")
    assert got(both) == [("a", 1), ("b", 2), ("c", 30)]


def test_joins(spark, got):
    a = spark.createDataFrame([("dva", "1", "m"), ("dvě", "1", "f")], "form string, cas string, gen string")
    b = spark.createDataFrame([("dny", "1", "m", "pl"), ("hodiny", "1", "f", "pl"), ("dny", "1", "m", "pl")], "form string, cas string, gen string, num string")
    assert got(R.agreement_join(a, b, ["cas", "gen"]), "form") == [("dva dny",), ("dvě hodiny",)]
    p = spark.createDataFrame([("x", 3), ("x", 10), ("y", 3)], "k string, p int")
    r = spark.createDataFrame([("x", 1, 5), ("x", 3, 3), ("x", 9, 2)], "k string, a int, b int")
    for width in (None, 2, 100):
        assert got(R.range_join(p, r, ["k"], "p", "a", "b", width), "p", "a") == [(3, 1), (3, 3)]
    q = spark.createDataFrame([("x", 2, "u"), ("x", 10, "v")], "k string, t int, s string")
    assert got(R.as_of_join(p, q, ["k"], "p", "t", "s", "out"), "k", "p", "out") == [("x", 10, "v"), ("x", 3, "u"), ("y", 3, None)]
    got_ext, rest = R.recover_split(p.where("p = 10"), p.where("p = 3"), "k")
    assert got(got_ext) == [("x", 10), ("x", 3)] and got(rest) == [("y", 3)]
    assert R.keys_differ(p, p.where("k = 'x'"), ["k"]).first().asDict() == {"only_left": 1, "only_right": 0, "both": 1}
    pairs = spark.createDataFrame([("x", "1")], "k string, v string")
    assert got(R.lookup(p, pairs, "k", "v", "o"), "k", "o") == [("x", "1"), ("x", "1"), ("y", None)]
    assert got(R.lookup(p, pairs, "k", "v", "o", keep_missing=True).where("k = 'y'"), "o") == [("y",)]


def test_frames(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0], 1, True), (2, [1.0, 0.0], 1, False)], "id int, x array<double>, y int, m boolean")
    out = frames.masked_loss(df, "x", "y", "m", weight=0.5).first()
    assert out["acc_mask"] == 1 and out["acc_unmask"] == 0 and out["loss"] == pytest.approx(0.5 * (out["loss_mask"] + out["loss_unmask"]))
    with pytest.raises(NotImplementedError):
        frames.masked_loss(df, "x", "y", "m", reduction="max")
    centres = spark.createDataFrame([(7, [0.0, 2.0]), (3, [1.0, 0.0])], "l int, c array<double>")
    assert [r["label"] for r in frames.nearest_centroid(df, "x", centres, "l", "c").orderBy("id").collect()] == [7, 3]
    with pytest.raises(ValueError):
        frames.with_centroids(df, centres, "l", "c", "o", limit=1)


def test_stream_equals_batch(spark, tmp_path, got):
    df = spark.range(600).select((F.col("id") % 3).alias("u"), F.timestamp_seconds(1_000_000 + F.col("id") * 37).alias("ts"), (F.floor(F.col("id") / 30) % 2).alias("v"))
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: windows.file_stream(spark, str(tmp_path), "events")
    for f in (lambda x: windows.tumbling(x, "ts", "10 minutes", ["u"], "v", "1 hour"), lambda x: windows.sliding(x, "ts", "10 minutes", "5 minutes", ["u"], "v")):
        assert got(windows.drain(spark, f(stream()))) == got(f(df))
    assert got(windows.drain(spark, windows.deduplicated(stream(), "ts", ["u"], "10 days"), "append"), "u") == [(0,), (1,), (2,)]
    runs = windows.drain(spark, windows.run_lengths(stream(), "u", "ts", F.col("v")), "append")
    assert runs.groupBy("key").count().collect()[0]["count"] == 19 and runs.agg(F.sum("n")).first()[0] == 570


def test_centres_batch_by_batch(spark):
    rows = [(i, [float(i % 2 * 10 + (i % 7) / 10), 0.0]) for i in range(200)] + [(900, None)]
    x = spark.createDataFrame(rows, "id int, v array<double>")
    centres = sorted(r["centre"] for r in frames.minibatch_centres(x, "v", "id", 6, batch=50).collect())
    assert len(centres) == 6 and all(min(c[0], abs(c[0] - 10)) < 1 for c in centres)
    near = frames.nearest_centroid(x.where("v is not null"), "v", frames.minibatch_centres(x, "v", "id", 6, batch=50), "label", "centre")
    assert near.agg(F.max("distance")).first()[0] < 1
    assert frames.minibatch_centres(x.where("false"), "v", "id", 3).count() == 0


def test_validated_rows_may_look_like_the_header(spark, tmp_path, got):
    (tmp_path / "1.csv").write_text('a,b\nx,"1,5"\na,b\n')
    (tmp_path / "2.csv").write_text('a,b\n"two\nlines",y\n')
    (tmp_path / "3.csv").write_text("a\nz\n")
    rows, bad = D.scan_validated(spark, str(tmp_path), "a string, b string", multiline=True)
    assert got(rows) == [("a", "b"), ("two\nlines", "y"), ("x", "1,5")] and [r["columns"] for r in bad.collect()] == [1]


def test_copy_plan(spark, got):
    listed = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    there = spark.createDataFrame([("a", "/1"), ("a", "/1"), ("b", "/2"), ("b", "/3"), ("d", "/4"), (None, "/5")], "k string, f string")
    assert got(D.copy_manifest(listed, there, "k", "f", "/out/")) == [("/1", "/out/a", 1, "copy"), ("/2", "/out/b", 2, "unclear"), (None, "/out/c", 0, "absent")]


def test_a_text_of_many_lines_is_one_row(spark, tmp_path, got):
    (tmp_path / "a.prt").write_text("one\ntwo \n\n")
    (tmp_path / "b.asr").write_text("three")
    assert got(D.whole_texts(spark, str(tmp_path)), "text") == [("one\ntwo",), ("three",)]
