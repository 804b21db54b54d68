"""Queries of joins, set operations and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import relational as rel
from chronolex.operators import timeline
from chronolex.operators.inflection import cardinal_forms as inflected
from chronolex.operators.inflection import with_noun
from chronolex.plans.base import ALIGNED, SEG, WORDS, aligned, segments, words
from chronolex.plans.registry import query, table

S = SparkSession
D = DataFrame


@query(f"WITH {WORDS}, {ALIGNED} SELECT word_id, word, true_w, dist FROM wrd JOIN ali ON id = word_id")
def join_left_drop(spark: S, d: str) -> D:
    """Equi-join with unmatched rows dropped."""
    return rel.join_found(words(spark, d), aligned(spark, d).withColumnRenamed("id", "word_id"), ["word_id"]).select("word_id", "word", "true_w", "dist")


#: A small invented paradigm table; tags are case, gender and number.
MORPH = [("jeden", "1", "masc", "sing"), ("jedna", "1", "fem", "sing"), ("jedno", "1", "neut", "sing"), ("jednoho", "2", "masc", "sing"), ("jedné", "2", "fem", "sing"), ("dva", "1", "masc", "pl"), ("dvě", "1", "fem", "pl"), ("dvou", "2", "fem", "pl"), ("pět", "1", "X", "pl"), ("pěti", "2", "X", "pl")]
NOUNS = [("hodina", "1", "fem", "sing"), ("hodiny", "2", "fem", "sing"), ("hodiny", "1", "fem", "pl"), ("hodin", "2", "fem", "pl"), ("den", "1", "masc", "sing"), ("dne", "2", "masc", "sing"), ("dny", "1", "masc", "pl"), ("dnů", "2", "masc", "pl"), ("metro", "1", "neut", "sing"), ("hodina", "1", "fem", "sing")]
_values = lambda rows: "(VALUES " + ", ".join(str(r) for r in rows) + ")"
_MORPH = f"m(form, cas, gen, num) AS (SELECT * FROM {_values(MORPH)}), n(form, cas, gen, num) AS (SELECT * FROM {_values(NOUNS)})"


def _morph(spark: S) -> tuple[D, D]:
    schema = "form string, cas string, gen string, num string"
    return spark.createDataFrame(MORPH, schema), spark.createDataFrame(NOUNS, schema)


@query(f"WITH {_MORPH} SELECT DISTINCT n.cas, n.gen, n.num, m.form || ' ' || n.form AS form FROM m JOIN n ON m.cas = n.cas AND m.gen = n.gen")
def agreement_join(spark: S, d: str) -> D:
    """Words agreeing in case and gender, many to many."""
    return rel.agreement_join(*_morph(spark), ["cas", "gen"])


@query(f"WITH {_MORPH} SELECT DISTINCT b.cas, b.gen, b.num, a.form || ' ' || n.form || ' ' || b.form AS form FROM m a JOIN n ON a.cas = n.cas AND a.gen = n.gen JOIN n b ON a.cas = b.cas AND a.gen = b.gen")
def agreement_chain(spark: S, d: str) -> D:
    """Agreement joins over three words."""
    m, n = _morph(spark)
    return rel.agreement_chain([m, n, n], ["cas", "gen"])


@query(f"WITH {_MORPH} SELECT DISTINCT m.form || ' ' || n.form AS form, m.cas, m.gen, m.num FROM m JOIN n ON m.cas = n.cas AND m.gen = n.gen AND m.num = n.num UNION SELECT DISTINCT m.form || ' ' || n.form, m.cas, m.gen, m.num FROM m JOIN n ON n.cas = '2' AND m.gen = n.gen")
def num_with_noun(spark: S, d: str) -> D:
    """Exact agreement, together with the genitive of the noun."""
    return with_noun(*_morph(spark))


LEMMAS = [("dvacet", "dvacet", "1", "fem", "pl"), ("dvacet", "dvaceti", "2", "fem", "pl"), ("dva", "dvě", "1", "fem", "pl"), ("dva", "dvou", "2", "fem", "pl"), ("sto", "sto", "1", "fem", "pl"), ("sto", "sta", "2", "fem", "pl")]


@query(f"""WITH m(lemma, form, cas, gen, num) AS (SELECT * FROM {_values(LEMMAS)}), low AS (SELECT DISTINCT b.cas, b.gen, b.num, a.form || ' ' || b.form AS form FROM m a JOIN m b ON a.cas = b.cas AND a.gen = b.gen WHERE a.lemma = 'dvacet' AND b.lemma = 'dva')
SELECT DISTINCT low.cas, low.gen, low.num, s.form || ' ' || low.form AS form FROM m s JOIN low ON s.cas = low.cas AND s.gen = low.gen WHERE s.lemma = 'sto' UNION SELECT cas, gen, num, 'sto ' || form FROM low""")
def cardinal_forms(spark: S, d: str) -> D:
    """A number with all words inflected, and with its last two digits inflected."""
    return inflected(spark.createDataFrame(LEMMAS, "lemma string, form string, cas string, gen string, num string"), 122)


#: The codes of the tag set that may stand for a gender, and for a number.
GENDERS = {
    "fem": ["H", "F", "Q", "T", "X"],
    "masc_i": ["Z", "X", "Y", "T", "I"],
    "masc_a": ["Z", "X", "Y", "M"],
    "neut": ["Z", "X", "Q", "N", "H"],
}
NUMBERS = {"pl": ["D", "P", "X"], "sing": ["D", "S", "X", "W"]}
_TAGS = [("a", "X", "F", "S"), ("b", "3", "T", "X"), ("c", "1", "Q", "D"), ("d", "2", None, "P"), ("e", "4", "", "S"), ("f", "5", "F", "")]


def _meanings(spark: S, codes: dict[str, list[str]], name: str, code: str) -> D:
    """One row a code and what it may mean."""
    return spark.createDataFrame([(c, meaning) for meaning, cs in codes.items() for c in cs], f"{code} string, {name} string")


@query("""WITH t(form, cas, gen, num) AS (VALUES ('a', 'X', 'F', 'S'), ('b', '3', 'T', 'X'), ('c', '1', 'Q', 'D'), ('d', '2', NULL, 'P'), ('e', '4', '', 'S'), ('f', '5', 'F', '')),
g(gender, code) AS (VALUES ('fem','H'),('fem','F'),('fem','Q'),('fem','T'),('fem','X'),('masc_i','Z'),('masc_i','X'),('masc_i','Y'),('masc_i','T'),('masc_i','I'),('masc_a','Z'),('masc_a','X'),('masc_a','Y'),('masc_a','M'),('neut','Z'),('neut','X'),('neut','Q'),('neut','N'),('neut','H')),
n(number, code) AS (VALUES ('pl','D'),('pl','P'),('pl','X'),('sing','D'),('sing','S'),('sing','X'),('sing','W')), c AS (SELECT CAST(unnest(range(1, 8)) AS VARCHAR) AS c)
SELECT form, c.c AS cas, gender, number FROM t JOIN g ON coalesce(gen, 'X') = g.code JOIN n ON coalesce(num, 'X') = n.code JOIN c ON t.cas = 'X' OR t.cas = c.c""")
def tag_expand(spark: S, d: str) -> D:
    """One row for each case, gender and number a tag may mean; an empty or unknown code means none."""
    cases = F.when(F.col("cas") == "X", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: i.cast("string"))).otherwise(F.array("cas"))
    t = spark.createDataFrame(_TAGS, "form string, cas string, gen string, num string")
    t = t.select("form", F.explode(cases).alias("cas"), F.coalesce("gen", F.lit("X")).alias("gen"), F.coalesce("num", F.lit("X")).alias("num"))
    t = t.join(_meanings(spark, GENDERS, "gender", "gen"), "gen").join(_meanings(spark, NUMBERS, "number", "num"), "num")
    return t.select("form", "cas", "gender", "number")


_ISLES = f"""WITH {SEG}, i AS (SELECT recording, min(idx) AS "start", max(idx) AS "end", count(*) AS cnt FROM (SELECT recording, idx, idx - row_number() OVER (PARTITION BY recording ORDER BY idx) AS run FROM seg) GROUP BY recording, run)"""


def _islands(spark: S, d: str) -> D:
    return timeline.islands(segments(spark, d), "recording", "idx")


@query(_ISLES + """ SELECT i.recording, i."start", i."end", CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, round(coalesce(sum(duration), 0), 4) AS duration, round(coalesce(sum(duration), 0) / 3600, 9) AS hours
FROM i JOIN seg ON seg.recording = i.recording AND idx BETWEEN i."start" AND i."end" GROUP BY 1, 2, 3""")
def run_sums(spark: S, d: str) -> D:
    """Words, characters and hours of each run of consecutive segments."""
    x = rel.interval_join(segments(spark, d), _islands(spark, d), ["recording"], "idx", "start", "end")
    return x.groupBy("recording", "start", "end").agg(
        F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 4).alias("duration"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600, 9).alias("hours")
    )


@query(_ISLES + """ SELECT i.recording, i."start", count(*) AS segments FROM i JOIN seg ON seg.recording = i.recording AND idx BETWEEN i."start" AND i."end" GROUP BY 1, 2""")
def range_join_agg(spark: S, d: str) -> D:
    """Range join over bins, then a count."""
    x = rel.range_join(segments(spark, d), _islands(spark, d), ["recording"], "idx", "start", "end", width=64)
    return x.groupBy("recording", "start").agg(F.count("*").alias("segments"))


_SPAN = f"""{WORDS}, span AS (SELECT split_part(segm, '/', 1) AS recording, segm, min(CASE WHEN NOT isnan(start_time) THEN start_time END) * 1000 AS a, max(CASE WHEN NOT isnan(end_time) THEN end_time END) * 1000 AS b FROM wrd GROUP BY 1, 2)"""


@query(f"WITH {_SPAN}, {ALIGNED} SELECT segm, id FROM span JOIN ali ON ali.recording = span.recording AND start >= a AND \"end\" <= b")
def time_containment(spark: S, d: str) -> D:
    """Aligned words that lie inside the window of a segment."""
    t = lambda c: F.when(~F.isnan(c), F.col(c))
    span = words(spark, d).groupBy(F.substring_index("segm", "/", 1).alias("recording"), "segm").agg((F.min(t("start_time")) * 1000).alias("a"), (F.max(t("end_time")) * 1000).alias("b"))
    x = rel.interval_join(aligned(spark, d), span, ["recording"], "start", "a", "b")
    return x.where(F.col("end") <= F.col("b")).select("segm", "id")


@query(f"WITH {ALIGNED} SELECT id, recording FROM ali WHERE id IN (SELECT word_id FROM words WHERE avg_char_duration > 0.15)")
def semi_words(spark: S, d: str) -> D:
    """Aligned rows of a list of word ids."""
    slow = table(spark, d, "words").where("avg_char_duration > 0.15").select(F.col("word_id").alias("id"))
    return aligned(spark, d).join(slow, "id", "left_semi").select("id", "recording")


_BUCKETS = f"""b AS (SELECT recording, CAST((row_number() OVER (ORDER BY recording) - 1) // greatest(1, (SELECT count(DISTINCT recording) FROM seg) // 10) AS BIGINT) AS bucket FROM (SELECT DISTINCT recording FROM seg WHERE recording IS NOT NULL))"""


def _buckets(spark: S, d: str) -> D:
    from chronolex.operators.batching import fixed_buckets

    return fixed_buckets(segments(spark, d), "recording", 10)


@query(f"WITH {SEG}, {_BUCKETS} SELECT seg.recording, idx, bucket FROM seg JOIN b ON b.recording = seg.recording")
def lookup_join(spark: S, d: str) -> D:
    """Recording to bucket."""
    return segments(spark, d).join(_buckets(spark, d), "recording").select("recording", "idx", "bucket")


@query("""WITH x AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS segm, CAST(split_part(path, '/', 3) AS BIGINT) AS frame, max(km25) AS km25, max(km100) AS km100 FROM cluster_labels WHERE km25 IS NOT NULL AND km100 IS NOT NULL GROUP BY 1, 2)
SELECT segm, list(km25 ORDER BY frame) AS km25, list(km100 ORDER BY frame) AS km100 FROM x GROUP BY segm""")
def label_sequence(spark: S, d: str) -> D:
    """Labels of each segment in frame order, an array for each k."""
    p = table(spark, d, "cluster_labels").where("km25 is not null and km100 is not null")
    x = p.select(F.substring_index("path", "/", 2).alias("segm"), F.substring_index("path", "/", -1).cast("long").alias("frame"), "km25", "km100")
    x = x.groupBy("segm", "frame").agg(F.max("km25").alias("km25"), F.max("km100").alias("km100"))
    x = x.groupBy("segm").agg(F.array_sort(F.collect_list(F.struct("frame", "km25", "km100"))).alias("s"))
    return x.select("segm", F.col("s.km25").alias("km25"), F.col("s.km100").alias("km100"))


def _recovered(spark: S, d: str) -> tuple[D, D]:
    x = segments(spark, d).select("recording", "idx", "type").where("recording is not null")
    return rel.recover_split(x.where(F.col("type").endswith("test")), x.where("type = 'other'"), "recording")


_SRC = "src AS (SELECT recording, idx, type FROM seg WHERE type LIKE '%test'), oth AS (SELECT recording, idx, type FROM seg WHERE type = 'other')"


@query(f"WITH {SEG}, {_SRC} SELECT * FROM src UNION ALL SELECT * FROM oth WHERE recording IN (SELECT recording FROM src)")
def extend_split(spark: S, d: str) -> D:
    """A split with the other segments of its recordings."""
    return _recovered(spark, d)[0]


@query(f"WITH {SEG}, {_SRC} SELECT * FROM oth WHERE recording NOT IN (SELECT recording FROM src)")
def reduced_other(spark: S, d: str) -> D:
    """What is left of the others."""
    return _recovered(spark, d)[1]


@query(f"""WITH {SEG}, a AS (SELECT DISTINCT recording, idx FROM seg), b AS (SELECT DISTINCT recording, idx FROM seg WHERE coverage >= 0.9)
SELECT count(*) FILTER (WHERE b.idx IS NULL) AS only_left, count(*) FILTER (WHERE a.idx IS NULL) AS only_right, count(*) FILTER (WHERE a.idx IS NOT NULL AND b.idx IS NOT NULL) AS both FROM a FULL JOIN b USING (recording, idx)""")
def set_equality(spark: S, d: str) -> D:
    """Keys of two tables compared."""
    x = segments(spark, d)
    return rel.keys_differ(x, x.where("coverage >= 0.9"), ["recording", "idx"])


@query("WITH a(x) AS (VALUES ('dva'), ('dvě')), b(y) AS (VALUES ('celé'), ('celá'), ('a')), c(z) AS (VALUES ('pět'), ('půl')) SELECT x || ' ' || y || ' ' || z AS variant FROM a, b, c")
def variant_product(spark: S, d: str) -> D:
    """All combinations of word variants."""
    arr = lambda *w: F.array(*map(F.lit, w))
    return spark.range(1).select(F.explode(rel.variant_product(arr("dva", "dvě"), arr("celé", "celá", "a"), arr("pět", "půl"))).alias("variant"))


@query(f"WITH {SEG} SELECT recording, list(idx ORDER BY idx) AS ids, list(words ORDER BY idx) AS words FROM seg GROUP BY recording")
def zip_arrays(spark: S, d: str) -> D:
    """Parallel lists zipped, sorted and parted again."""
    x = segments(spark, d).groupBy("recording").agg(F.collect_list("idx").alias("i"), F.collect_list("words").alias("w"))
    x = x.withColumn("z", F.array_sort(F.arrays_zip("i", "w")))
    return x.select("recording", F.transform("z", lambda s: s["i"]).alias("ids"), F.transform("z", lambda s: s["w"]).alias("words"))


_GRID = f"""s AS (SELECT recording, idx, duration AS s FROM seg WHERE type = 'train' AND duration IS NOT NULL), f AS (SELECT recording, idx, duration AS f FROM seg WHERE type <> 'train' AND duration IS NOT NULL AND recording IN (SELECT recording FROM s)),
u AS (SELECT recording, idx, s, f FROM s FULL JOIN f USING (recording, idx)), g AS (SELECT *, coalesce(lag(idx) OVER (PARTITION BY recording ORDER BY idx), -1) + 1 AS free FROM u WHERE idx >= 0),
grid AS (SELECT recording, idx, CAST(1 AS BIGINT) AS cnt, CASE WHEN f IS NOT NULL THEN 1 ELSE 2 END AS origin, coalesce(f, s) AS duration FROM g UNION ALL SELECT recording, free, idx - free, 0, 5.0 * (idx - free) FROM g WHERE idx > free)"""


def stretches(spark: S, d: str) -> D:
    """The grid of all indexes from 0 on, an empty stretch as one row with its count."""
    x = segments(spark, d).where("duration is not null")
    return timeline.fallback_stretches(x.where("type = 'train'"), x.where("type <> 'train'"), "recording", "idx", "duration")


@query(f"WITH {SEG}, {_GRID} SELECT recording, idx, cnt, origin, duration FROM grid")
def fallback_grid(spark: S, d: str) -> D:
    """Every index with its source, fallback before original; ``cnt`` missing ones in a row are one stretch."""
    return stretches(spark, d).select("recording", "idx", "cnt", "origin", "duration")


@query(f"""WITH {SEG}, {_GRID}, m AS (SELECT recording, min(idx) AS a, max(idx) AS b FROM u GROUP BY recording), l AS (SELECT recording, unnest(range(a, b + 1)) AS idx FROM m)
SELECT l.recording, string_agg(CASE WHEN s IS NOT NULL AND f IS NOT NULL THEN CAST(l.idx AS VARCHAR) || '--[' || CAST(l.idx AS VARCHAR) || ']' WHEN s IS NOT NULL THEN CAST(l.idx AS VARCHAR) WHEN f IS NOT NULL THEN '[' || CAST(l.idx AS VARCHAR) || ']' ELSE '@' END, '--' ORDER BY l.idx) AS line
FROM l LEFT JOIN u ON u.recording = l.recording AND u.idx = l.idx GROUP BY l.recording""")
def recover_map(spark: S, d: str) -> D:
    """Which source has each index, as one line a recording."""
    x = segments(spark, d).where("duration is not null")
    s = x.where("type = 'train'")
    return timeline.recover_map(s, x.where("type <> 'train'").join(s.select("recording"), "recording", "left_semi"), "recording", "idx")


@query(f"WITH {SEG} SELECT recording, idx, duration FROM seg ORDER BY duration DESC NULLS LAST, recording, idx")
def sort_desc(spark: S, d: str) -> D:
    """Descending, nulls last, ties by key."""
    return segments(spark, d).orderBy(F.desc_nulls_last("duration"), "recording", "idx").select("recording", "idx", "duration")


@query(f"WITH {SEG} SELECT DISTINCT type FROM seg ORDER BY type")
def sorted_distinct(spark: S, d: str) -> D:
    """Distinct values in order."""
    return segments(spark, d).select("type").distinct().orderBy("type")


@query(f"WITH {SEG} SELECT DISTINCT recording FROM seg ORDER BY recording LIMIT 5")
def prefix_n(spark: S, d: str) -> D:
    """The first keys in order."""
    return segments(spark, d).select("recording").distinct().orderBy("recording").limit(5)


@query(f"WITH {WORDS}, {ALIGNED} SELECT word_id AS id, word, NULL AS recording FROM wrd UNION ALL SELECT id, NULL, recording FROM ali")
def union_all(spark: S, d: str) -> D:
    """Rows of two tables by column name."""
    return rel.union_all(words(spark, d).select(F.col("word_id").alias("id"), "word"), aligned(spark, d).select("id", "recording"))


@query(f"WITH {WORDS}, {ALIGNED} SELECT lower(word) AS form FROM wrd UNION SELECT true_w FROM ali")
def union_distinct(spark: S, d: str) -> D:
    """Union without repeats."""
    return words(spark, d).select(F.lower("word").alias("form")).union(aligned(spark, d).select("true_w")).distinct()


@query(f"WITH {SEG} SELECT recording, min(idx) AS lowest, max(idx) AS highest, bool_or(idx = 5) AS has_five FROM seg GROUP BY recording")
def array_setops(spark: S, d: str) -> D:
    """Membership, minimum and maximum of a set."""
    x = segments(spark, d).groupBy("recording").agg(F.collect_set("idx").alias("s"))
    return x.select("recording", F.array_min("s").alias("lowest"), F.array_max("s").alias("highest"), F.array_contains("s", F.lit(5).cast("long")).alias("has_five"))


@query(f"WITH {SEG}, {_BUCKETS} SELECT recording, bucket, CASE WHEN bucket < greatest(1, CAST(floor((SELECT max(bucket) + 1 FROM b) * 0.2) AS BIGINT)) THEN 'val' ELSE 'train' END AS side FROM b")
def val_split(spark: S, d: str) -> D:
    """The first buckets for validation."""
    from chronolex.operators.batching import validation_split

    return validation_split(_buckets(spark, d), "bucket", 0.2)


@query()
def hash_split(spark: S, d: str) -> D:
    """Rows parted 0.8 to 0.2 by a hash of their key."""
    from chronolex.operators.batching import hash_split as split

    return split(segments(spark, d).select("recording", "idx"), "recording", {"train": 0.8, "dev": 0.2}).groupBy("side").agg(F.count("*").alias("n"))


@query()
def permutation(spark: S, d: str) -> D:
    """All segments in a seeded random order."""
    from chronolex.operators.batching import permuted

    x = segments(spark, d).select(F.concat_ws("/", "recording", "idx").alias("segment"))
    return permuted(x, "segment", seed=7)
