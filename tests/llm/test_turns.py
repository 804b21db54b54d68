import itertools
import random

from pyspark.sql import functions as F

from chronolex.llm import speakers as P
from chronolex.llm import turns as T

ROSTER = [(1, "Temur", "Zározna", "senátor"), (2, "Sazimíra", "Tehaznová", "senátor"), (3, "Dobrana", "Tehaznová", "host"), (4, "Lumirad", "Klaveralka", "předsedající"), (5, None, "Bez", None), (6, "X", None, None)]


def roster(spark):
    return spark.createDataFrame(ROSTER, "speaker_id int, given_name string, surname string, role_name string")


def labelled(spark, rows):
    df = spark.createDataFrame(rows, "t string, l string")
    return {(r["transcript"], r["label"]): r["speaker_id"] for r in P.resolve_labels(df, roster(spark), transcript=F.col("t"), label=F.col("l")).collect()}


def test_spellings(spark):
    one = ["Temur Zározna", "ZÁROZNA, Temur", "temur.zarozna", "#TemurZarozna", "T. Zározna", "Zározna", " Temur Zározna ", "Ing. Temur Zározna, Ph.D.", "Senátor Temur Zározna:", "Temur Zározna", "Temur Záorzna", "Temur Zárona", "Temur Zárroozna"]
    other = {"Tehaznová (host)": 3, "S. Tehaznová": 2, "Dobrana Tehzanová": 3}
    nobody = ["", " ", "-", "???", "neznámý", "123", None]
    got = labelled(spark, [("r", x) for x in [*one, *other, *nobody]])
    assert got == {(None, x): 1 for x in one} | {(None, x): i for x, i in other.items()}


def test_any_lost_doubled_or_swapped_letter_meets_its_name():
    for name in ("hrumorostek", "pasoskulkek", "zarozna", "bricedrinkon", "klaveralka"):
        keys = P.block_keys(name)
        for i in range(len(name)):
            assert keys & P.block_keys(name[:i] + name[i + 1 :])
            assert keys & P.block_keys(name[: i + 1] + name[i:])
            assert keys & P.block_keys(name[:i] + name[i + 1 : i + 2] + name[i] + name[i + 2 :])


def test_ties_are_decided_in_the_transcript(spark):
    got = labelled(spark, [("r1", "Tehaznová"), ("r1", "Dobrana Tehaznová"), ("r2", "Tehaznová"), ("r3", "Tehaznová"), ("r3", "Dobrana Tehaznová"), ("r3", "Sazimíra Tehaznová")])
    assert got[("r1", "Tehaznová")] == 3 and ("r2", "Tehaznová") not in got and ("r3", "Tehaznová") not in got


def test_assignment_is_optimal():
    r = random.Random(1)
    for n, m in ((1, 1), (2, 4), (4, 4), (3, 5)):
        c = [[r.random() for _ in range(m)] for _ in range(n)]
        best = min(sum(c[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert abs(sum(c[i][j] for i, j in enumerate(P.assign(c))) - best) < 1e-9


def spoken(spark, rows, shard=120.0):
    df = spark.createDataFrame(rows, "segm string, word string, who string, a double, b double, id string").withColumn("event", F.lit("clash")).withColumn("label", F.lit(0))
    return T.spoken_words(df, roster(spark), segment=F.col("segm"), word=F.col("word"), speaker=F.col("who"), start=F.col("a"), end=F.col("b"), tie=F.col("id"), transcript=F.lit("r"), shard=shard)


Z, K = "Temur Zározna", "Lumirad Klaveralka"


def test_no_words_and_words(spark):
    no = ["eee", "Ehm,", "hmm…", "é-é", "[smích]", "*Šum.*", "<t=53.5>", "(00:01:18.9)", "[01:57]", "00:00:16", "{potlesk}", "[[gong]]", " ", "…hm."]
    yes = ["(9).", "12.30", "§?", "e-mail", "a", "A?", "109.", "i", "[5]", "mám"]
    rows = [("s", w, Z, float(i), None, None) for i, w in enumerate([*no, *yes])]
    got = [r["word"] for r in spoken(spark, rows).orderBy("start").collect()]
    assert got == yes


def test_notes_over_rows_unnamed_words_and_shards(spark):
    rows = [
        ("s", "tak", "-", 1.0, 2.0, "1"), ("s", "(ruch", K, 3.0, None, None), ("s", "v", K, 4.0, None, None), ("s", "sále)", K, 5.0, None, None),
        ("s", "ano", Z, 6.0, 7.0, "2"), ("s", "ano", Z, 6.0, 7.0, "2"), ("s", "dál", None, 8.0, 9.0, "3"), ("s", "*dlouhý", None, 9.0, None, None), ("s", "smích*", None, 9.5, None, None),
        ("s", "prosím", K, 10.0, None, "4"), ("s", "(otevřená", None, 11.0, None, None), ("s", "děkuji", "???", 12.0, None, "5"), ("s", "lost", K, None, None, None), ("s", "nan", K, float("nan"), None, None),
        ("q", "nikdo", "-", 1.0, None, None), (None, "w", Z, 1.0, None, None), ("s", None, Z, 1.5, None, None),
    ]
    for shard in (1.0, 3.0, 500.0):
        w = spoken(spark, rows, shard)
        text = [(r["turn"], r["speaker_id"], r["start"], r["text"]) for r in T.turns(w).orderBy("segm", "turn").collect()]
        assert text == [(0, 1, 1.0, "tak ano dál"), (1, 4, 10.0, "prosím (otevřená děkuji")]
        assert w.where("segm = 'q'").select("speaker_id", "opens").collect()[0] == (None, False)


def test_empty(spark):
    assert spoken(spark, []).collect() == []


def one_by_one(rows):
    """The same rules over the tokens of a segment in order, nothing cut: (start, word, speaker, opens)."""
    out = []
    for segm in sorted({r[0] for r in rows}):
        tokens = sorted({r for r in rows if r[0] == segm}, key=lambda r: (r[3], r[4] if r[4] is not None else float("inf"), r[5] or "~", r[1]))
        events = []
        for r in tokens:
            w = r[1]
            events.append(" " if w in ("(x)", "eee") else "o" + w[0] if w[0] in "([" else "c" + {")": "(", "]": "["}[w[-1]] if w[-1] in ")]" else " ")
        words = []
        for i, r in enumerate(tokens):
            before = [e for e in events[: i + 1] if e != " "]
            behind = [e for e in events[i + 1 :] if e != " "]
            open_note = bool(before) and bool(behind) and before[-1][0] == "o" and behind[0] == "c" + before[-1][1]
            earlier = [e for e in events[:i] if e != " "]
            closes = events[i][0] == "c" and bool(earlier) and earlier[-1] == "o" + events[i][1]
            if r[1] not in ("(x)", "eee") and not open_note and not closes:
                words.append(r)
        named = {Z: 1, K: 4}
        now = next((named[r[2]] for r in words if r[2] in named), None)
        last = None
        for r in words:
            now = named.get(r[2], now)
            out.append((segm, r[3], r[1], now, now is not None and now != last))
            last = now
    return out


def test_any_cut_gives_what_the_whole_segment_gives(spark):
    r = random.Random(11)
    rows = []
    for s in range(25):
        for i in range(r.randrange(1, 40)):
            word = r.choice(["ano", "ne", "tak", "(ruch", "sále)", "[gong", "dlouhý]", "(x)", "eee"])
            rows.append((f"s{s:02d}", word, r.choice([Z, K, None, "-", None]), float(i) + r.random() / 2, None, f"{i:03d}"))
    want = one_by_one(rows)
    for shard in (0.7, 2.0, 9.0, 1000.0):
        got = [tuple(x) for x in spoken(spark, rows, shard).orderBy("segm", "start").select("segm", "start", "word", "speaker_id", "opens").collect()]
        assert got == want
    df = spark.createDataFrame(rows, "segm string, word string, who string, a double, b double, id string")
    opened = T.turn_starts(df, roster(spark), segment=F.col("segm"), word=F.col("word"), speaker=F.col("who"), start=F.col("a"), end=F.col("b"), tie=F.col("id"), transcript=F.lit("r"), shard=2.0)
    assert sorted((x["segm"], x["start"], x["speaker_id"]) for x in opened.collect()) == [(s, t, who) for s, t, _, who, opens in want if opens]


def test_small_batches_do_not_tear_shards(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(f"s{i % 3}", r, Z if i % 7 == 0 else K, float(i), None, str(i)) for i, r in enumerate(["ano", "(ruch", "v", "sále)", "ne"] * 20)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        small = [tuple(x) for x in spoken(spark, rows, 1e6).orderBy("segm", "start").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert small == [tuple(x) for x in spoken(spark, rows, 1e6).orderBy("segm", "start").collect()]
    assert [x[3:6] for x in small] == [(t, w, who) for _, t, w, who, _ in one_by_one(rows)]
