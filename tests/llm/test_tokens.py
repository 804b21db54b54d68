import os

import pytest
from pyspark.sql import functions as F

from chronolex.llm import tokens as T
from chronolex.llm.ranks import running

needs_ranks = pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no rank file here")


@needs_ranks
def test_counts_and_round_trip(spark):
    e = T.encoding(T.RANKS)
    text = "Pane předsedající, 12.30 § e-mail 🙂\n\n  <|endoftext|>"
    assert e.decode(e.encode_ordinary(text)) == text
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a" * 50_000)], "id int, t string")
    got = {r["id"]: r["n"] for r in df.select("id", T.token_count(F.col("t")).alias("n")).collect()}
    assert got[1] == len(e.encode_ordinary(text)) and got[2] == got[3] == 0 and got[4] > 1000


def test_running_sums_over_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 100).alias("b"), "id", (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["before"] for r in running(df, ["g"], "b", ["id"], "n").collect()}
    assert got == {i: sum(j % 7 for j in range(i) if j % 3 == i % 3) for i in range(1000)}
    assert running(df.limit(0), ["g"], "b", ["id"]).collect() == []
