"""Queries of string functions, transcripts and number words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import align, numerals
from chronolex.functions import numeric as N
from chronolex.functions import text as T
from chronolex.functions import transcripts
from chronolex.functions.transcripts import ABBREVIATIONS
from chronolex.plans.base import ALIGNED, SEG, WORDS, aligned, segments, words
from chronolex.plans.registry import query, spread, table

S = SparkSession
D = DataFrame


@query("SELECT path, split_part(path, '/', 1) AS a, split_part(path, '/', 2) AS b, split_part(path, '/', 3) AS c FROM cluster_labels")
def split_expand(spark: S, d: str) -> D:
    """A path split into three columns."""
    p = F.split("path", "/")
    return table(spark, d, "cluster_labels").select("path", *(F.get(p, i).alias(n) for i, n in enumerate("abc")))


@query("SELECT doc_id, replace(text, ' ', '_') AS joined FROM documents WHERE text IS NOT NULL")
def join_parts(spark: S, d: str) -> D:
    """Pieces joined by another sign."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.split("text", " "), "_").alias("joined"))


@query(f"WITH {SEG} SELECT recording, idx, '/srv/' || type || '/' || recording || '/' || CAST(idx AS VARCHAR) AS path FROM seg")
def compose_path(spark: S, d: str) -> D:
    """A path from its pieces, null if one is."""
    return segments(spark, d).select("recording", "idx", T.compose(F.lit("/srv/"), F.col("type"), F.lit("/"), F.col("recording"), F.lit("/"), F.col("idx").cast("string")).alias("path"))


@query(f"WITH {SEG} SELECT recording, idx, lpad(CAST(idx AS VARCHAR), CAST(max(length(CAST(idx AS VARCHAR))) OVER (PARTITION BY recording) AS INT), '0') AS padded FROM seg")
def lpad_group(spark: S, d: str) -> D:
    """Numbers padded to the widest of their recording."""
    return segments(spark, d).select("recording", "idx", T.pad_in_group(F.col("idx"), F.col("recording")).alias("padded"))


@query("SELECT DISTINCT recording, substr(recording, 7, 2) || '.' || substr(recording, 5, 2) || '.' || substr(recording, 1, 4) AS day, substr(recording, 9, 2) || ':' || substr(recording, 11, 2) AS start, substr(recording, 13, 2) || ':' || substr(recording, 15, 2) AS \"end\" FROM documents WHERE recording IS NOT NULL")
def parse_fixed_id(spark: S, d: str) -> D:
    """Date and times inside a recording id."""
    x = table(spark, d, "documents").select("recording").where("recording is not null").distinct()
    return x.select("recording", *(c.alias(n) for n, c in T.fixed_id(F.col("recording")).items()))


@query("SELECT doc_id, lower(text) AS low, upper(source) AS up FROM documents")
def case_fold(spark: S, d: str) -> D:
    """Lower and upper case."""
    return table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"), F.upper("source").alias("up"))


@query("SELECT doc_id, regexp_replace(source, '\\s+$', '') AS \"right\", regexp_replace(source, '^\\s+', '') AS \"left\" FROM documents")
def trim_ws(spark: S, d: str) -> D:
    """White space of any kind taken off either end."""
    return table(spark, d, "documents").select("doc_id", T.trimmed_right(F.col("source")).alias("right"), F.regexp_replace("source", r"^\s+", "").alias("left"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'obce') > 0 THEN substr(text, 1, strpos(text, 'obce') - 1) || 'MĚSTA' || substr(text, strpos(text, 'obce') + 4) ELSE text END AS text FROM documents")
def replace_first(spark: S, d: str) -> D:
    """The first occurrence replaced."""
    return table(spark, d, "documents").select("doc_id", T.replace_first(F.col("text"), F.lit("obce"), F.lit("MĚSTA")).alias("text"))


@query(f"WITH {WORDS} SELECT word_id, translate(word, '{T.ACCENTED}', '{T.PLAIN}') AS plain FROM wrd")
def strip_accents(spark: S, d: str) -> D:
    """Letters without accents."""
    return words(spark, d).select("word_id", T.strip_accents(F.col("word")).alias("plain"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ABBREVIATIONS.items())


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda t: CASE t {_CASES} ELSE t END), ' ') AS text FROM documents")
def expand_abbr(spark: S, d: str) -> D:
    """Abbreviations written out, token by token."""
    return table(spark, d, "documents").select("doc_id", T.expand_words(F.col("text"), ABBREVIATIONS).alias("text"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]') AS digits FROM documents")
def has_digits(spark: S, d: str) -> D:
    """Whether a text has digits."""
    return table(spark, d, "documents").select("doc_id", T.has_digits(F.col("text")).alias("digits"))


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS digits, regexp_extract_all(text, '([0-9]+) hodin[y]?', 1) AS hours FROM documents")
def find_digits(spark: S, d: str) -> D:
    """All numbers, and those before the word for hours."""
    return table(spark, d, "documents").select("doc_id", T.find_digits(F.col("text")).alias("digits"), T.find_hours(F.col("text")).alias("hours"))


_SPOKEN = "spoken AS (SELECT segm, string_agg(word, ' ' ORDER BY start_time, word_id) AS t FROM (SELECT DISTINCT segm, word, start_time, word_id FROM words WHERE start_time IS NOT NULL AND word_id IS NOT NULL) GROUP BY segm)"


def _spoken(spark: S, d: str) -> D:
    x = table(spark, d, "words").where("start_time is not null and word_id is not null").select("segm", "word", "start_time", "word_id").distinct()
    x = x.groupBy("segm").agg(F.array_sort(F.collect_list(F.struct("start_time", "word_id", "word"))).alias("w"))
    return x.select("segm", F.array_join(F.col("w.word"), " ").alias("t"))


@query(f"WITH {_SPOKEN} SELECT segm, list_filter(regexp_extract_all(t, '[0-9]+\\.[0-9]+'), lambda x: regexp_full_match(x, '[0-9]{{2}}\\.[0-9]{{2}}')) AS times FROM spoken")
def find_times(spark: S, d: str) -> D:
    """Clock times spoken in a segment."""
    return _spoken(spark, d).select("segm", T.find_times(F.col("t")).alias("times"))


#: The texts with every full stop and comma a token of its own.
_TOKENS = "tok AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.,])', ' \\1 ', 'g'), ' +', ' ', 'g') AS t FROM documents)"


def _tokens(spark: S, d: str) -> D:
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "([.,])", " $1 "), " +", " ").alias("t"))


@query(f"WITH {_TOKENS}, y AS (SELECT doc_id, list_transform(regexp_extract_all(t, '[0-9]+\\s\\.\\s[0-9]+\\s\\.\\s*[0-9]*'), lambda v: trim(regexp_replace(replace(v, '.', ' '), '\\s+', ' ', 'g'))) AS c FROM tok) SELECT doc_id, list_filter(c, lambda v: coalesce(TRY_CAST(split_part(v, ' ', 1) AS INT), 0) BETWEEN 1 AND 31 AND coalesce(TRY_CAST(split_part(v, ' ', 2) AS INT), 0) BETWEEN 0 AND 12) AS dates FROM y")
def find_dates(spark: S, d: str) -> D:
    """Dates of day and month, impossible ones left out."""
    return _tokens(spark, d).select("doc_id", T.find_dates(F.col("t")).alias("dates"))


@query(f"WITH {_TOKENS} SELECT doc_id, regexp_extract_all(t, '([0-9]+)\\s?\\.\\s(?:led|únor|břez|dub|květ|červen|červ|srp|září|říj|listopad|prosin)', 1) AS days FROM tok")
def find_month_dates(spark: S, d: str) -> D:
    """Days before the name of a month."""
    return _tokens(spark, d).select("doc_id", T.find_month_dates(F.col("t")).alias("days"))


@query()
def find_floats(spark: S, d: str) -> D:
    """Decimals found by the ordered rules."""
    return spread(_tokens(spark, d), "doc_id").select("doc_id", T.find_floats(F.col("t")).alias("floats"))


@query("SELECT doc_id, CASE WHEN strpos(r, 'města') > 0 THEN substr(r, 1, strpos(r, 'města') - 1) || 'KRAJE' || substr(r, strpos(r, 'města') + 5) ELSE r END AS text FROM (SELECT doc_id, CASE WHEN strpos(text, 'obce') > 0 THEN substr(text, 1, strpos(text, 'obce') - 1) || 'MĚSTA' || substr(text, strpos(text, 'obce') + 4) ELSE text END AS r FROM documents)")
def apply_replacements(spark: S, d: str) -> D:
    """Replacements in order, each of its first occurrence, in capitals."""
    pair = lambda a, b: F.struct(F.lit(a).alias("find"), F.lit(b).alias("by"))
    return table(spark, d, "documents").select("doc_id", T.apply_replacements(F.col("text"), F.array(pair("obce", "města"), pair("města", "kraje"))).alias("text"))


@query("SELECT doc_id, list_transform(list_sort(list_transform(['obce', 'zákon', 'a'], lambda i: {'at': strpos(text, i), 'item': i})), lambda s: s.item) AS items FROM documents WHERE text IS NOT NULL")
def by_position(spark: S, d: str) -> D:
    """Items in order of where they first stand, absent ones first."""
    items = F.array(*map(F.lit, ("obce", "zákon", "a")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.by_position(F.col("text"), items).alias("items"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]+\\s?,\\s?[0-9]+') AS floats, len(list_filter(regexp_extract_all(text, '[0-9]+\\.[0-9]+'), lambda x: regexp_full_match(x, '[0-9]{2}\\.[0-9]{2}'))) > 0 AS times FROM documents")
def digit_classes(spark: S, d: str) -> D:
    """Which kinds of numbers a text has."""
    c = T.digit_classes(F.col("text"))
    return table(spark, d, "documents").select("doc_id", c["floats"].alias("floats"), c["times"].alias("times"))


@query(f"WITH {WORDS} SELECT word_id, 'a' || word AS prefixed, word || '.' AS suffixed FROM wrd")
def prefix_rows(spark: S, d: str) -> D:
    """A prefix and a suffix on each value."""
    return words(spark, d).select("word_id", F.concat(F.lit("a"), "word").alias("prefixed"), F.concat("word", F.lit(".")).alias("suffixed"))


@query(f"WITH {SEG} SELECT recording, idx, printf('%02d-%04d_%.3f', idx % 100, words, coalesce(duration, 0)) AS name FROM seg")
def run_name(spark: S, d: str) -> D:
    """Numbers formatted into a name."""
    return segments(spark, d).select("recording", "idx", F.format_string("%02d-%04d_%.3f", F.pmod("idx", F.lit(100)), F.col("words"), F.coalesce("duration", F.lit(0.0))).alias("name"))


_plain = lambda c: f"regexp_replace(translate({c}, '{T.ACCENTED}', '{T.PLAIN}'), '[^ -~]', '_', 'g')"


@query(f"WITH {ALIGNED} SELECT id, greatest(length({_plain('true_w')}), length({_plain('trans_w')})) - levenshtein({_plain('true_w')}, {_plain('trans_w')}) AS similarity FROM ali")
def edit_similarity(spark: S, d: str) -> D:
    """How much of the longer word two words share."""
    a, b = (F.regexp_replace(T.strip_accents(F.col(c)), "[^ -~]", "_") for c in ("true_w", "trans_w"))
    return aligned(spark, d).select("id", N.edit_similarity(a, b).cast("long").alias("similarity"))


_PLACE = r"^(.*)-(\d{1,18})$"


def _transcripts(spark: S, d: str) -> D:
    """(recording, segment, gold, heard): true and recognised words of each whole segment, in the order of their ids.

    A word's id is its segment and its place in it, so words without times stay where they were said.
    """
    x = aligned(spark, d).where(F.col("id").rlike(_PLACE))
    word = F.struct(F.regexp_extract("id", _PLACE, 2).cast("long").alias("at"), "true_w", "trans_w")
    x = x.groupBy("recording", F.regexp_extract("id", _PLACE, 1).alias("segment")).agg(F.array_sort(F.collect_set(word)).alias("w"))
    x = spread(x, "segment")  # few bytes, much work
    return x.select("recording", "segment", F.array_join(F.col("w.true_w"), " ").alias("gold"), F.array_join(F.filter(F.col("w.trans_w"), lambda t: t.isNotNull() & (t != "")), " ").alias("heard"))


@query()
def local_align(spark: S, d: str) -> D:
    """Score of the best local alignment of what was said and heard."""
    return _transcripts(spark, d).select("recording", "segment", F.round(align.alignment_score(F.col("gold"), F.col("heard"), True), 6).alias("score"))


@query()
def global_align(spark: S, d: str) -> D:
    """Score of the best alignment from end to end."""
    return _transcripts(spark, d).select("recording", "segment", F.round(align.alignment_score(F.col("gold"), F.col("heard"), False), 6).alias("score"))


@query()
def print_alignment(spark: S, d: str) -> D:
    """The best alignment from end to end as two lines of columns."""
    return _transcripts(spark, d).select("recording", "segment", align.alignment_text(F.col("gold"), F.col("heard"), False).alias("lines"))


@query()
def normalise_transcript(spark: S, d: str) -> D:
    """Whole transcripts with numbers written the way they were spoken, a row for each of the best ways."""
    x = _transcripts(spark, d).select("recording", "segment", transcripts.normalise_transcript(F.col("gold"), F.col("heard")).alias("texts"))
    return x.select("recording", "segment", F.explode("texts").alias("text"))


def _spelt(c: str) -> Column:
    """Digits as a number where words go so far, else null."""
    n = F.col(c).try_cast("long")
    return F.when(n < 10**12, n)


_arr = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _below(k: str, gender: str = "") -> str:
    """SQL of the words of a number from 1 to 999."""
    ones = ["", *numerals.ONES[1:]]
    if gender == "masc":
        ones[1] = "jeden"
    if gender == "fem":
        ones[2] = "dvě"
    one = lambda i: f"nullif(list_extract({_arr(ones)}, CAST({i} AS INT) + 1), '')"
    return f"concat_ws(' ', nullif(list_extract({_arr(numerals.HUNDREDS)}, CAST({k} // 100 AS INT) + 1), ''), CASE WHEN {k} % 100 >= 20 THEN list_extract({_arr(numerals.TENS)}, CAST({k} % 100 // 10 AS INT) + 1) END, CASE WHEN {k} % 100 >= 20 THEN {one(f'{k} % 10')} ELSE {one(f'{k} % 100')} END)"


def _in_words(n: str) -> str:
    """SQL of ``cardinal`` below 10**12."""
    parts = []
    for size, single, few, many, gender in numerals.SCALES:
        k = f"({n} // {size} % 1000)"
        parts.append(f"CASE WHEN {k} > 0 THEN concat_ws(' ', CASE WHEN {k} > 1 THEN {_below(k, gender)} END, CASE WHEN {k} = 1 THEN '{single}' WHEN {k} < 5 THEN '{few}' ELSE '{many}' END) END")
    return f"CASE WHEN {n} = 0 THEN 'nula' ELSE concat_ws(' ', {', '.join(parts)}, nullif({_below(f'({n} % 1000)')}, '')) END"


@query(f"WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS n FROM documents), k AS (SELECT *, TRY_CAST(n AS BIGINT) AS v FROM d) SELECT doc_id, n, CASE WHEN v < 1000000000000 THEN {_in_words('v')} END AS words FROM k")
def cardinal_words(spark: S, d: str) -> D:
    """Numbers of a text in words, null from 10**12 on."""
    x = table(spark, d, "documents").select("doc_id", F.explode(T.find_digits(F.col("text"))).alias("n"))
    return x.select("doc_id", "n", numerals.cardinal_words(_spelt("n")).alias("words")).distinct()


_TURNED = f"SELECT unnest([l || 'a' || t, l || ' a ' || t]) AS tail, id FROM (SELECT id, list_extract({_arr(numerals.ONES)}, CAST(id % 10 AS INT) + 1) AS l, list_extract({_arr(numerals.TENS)}, CAST(id % 100 // 10 AS INT) + 1) AS t FROM n WHERE id % 10 > 0 AND id % 100 > 20)"


@query(f"""WITH n AS (SELECT unnest(range(0, 12000)) AS id), turned AS ({_TURNED}), tails AS (SELECT id, tail FROM turned UNION ALL SELECT id, {_in_words('(id % 100)')} FROM n WHERE id % 100 > 0)
SELECT id, {_in_words('id')} AS variant FROM n UNION SELECT id, CASE WHEN id >= 100 THEN {_in_words('(id - id % 100)')} || ' ' ELSE '' END || tail FROM turned
UNION SELECT id, {_in_words('(id // 100)')} || ' set' FROM n WHERE id BETWEEN 1100 AND 1999 AND id % 100 = 0 UNION SELECT id, {_in_words('(id // 100)')} || ' set ' || tail FROM tails WHERE id BETWEEN 1100 AND 1999
UNION SELECT id, {_in_words('(id // 100)')} || ' ' || {_in_words('(id % 100)')} FROM n WHERE id BETWEEN 1000 AND 9999 AND id % 100 > 0""")
def number_variants(spark: S, d: str) -> D:
    """All spoken forms of the numbers below 12000."""
    return spark.range(12000).select("id", F.explode(numerals.number_variants(F.col("id"))).alias("variant"))


@query()
def number_expansions(spark: S, d: str) -> D:
    """Numbers of the documents spoken group by group, the ways of the groups combined; null from 10**12 on."""
    x = table(spark, d, "documents").select(F.explode(T.find_digits(F.col("text"))).alias("n")).distinct()
    return x.select("n", F.explode_outer(numerals.number_expansions(_spelt("n"))).alias("variant"))


@query()
def time_variants(spark: S, d: str) -> D:
    """Spoken forms of the clock times of a day."""
    x = spark.range(24 * 60).select(F.format_string("%02d.%02d", F.floor(F.col("id") / 60), F.pmod("id", F.lit(60))).alias("time"))
    return x.select("time", F.explode(numerals.spoken_times(F.col("time"))).alias("variant"))


@query()
def decimal_variants(spark: S, d: str) -> D:
    """Spoken forms of the decimals of the documents."""
    x = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\d+,\d+"), F.lit(0))).alias("decimal")).distinct()
    return x.select("decimal", F.explode(numerals.spoken_decimals(F.col("decimal"))).alias("variant"))


@query(f"SELECT CAST(n AS INT) AS n, concat_ws(' ', nullif(list_extract({_arr(numerals.ORDINAL_HUNDREDS)}, CAST(n // 100 AS INT) + 1), ''), CASE WHEN n % 100 >= 20 THEN list_extract({_arr(numerals.ORDINAL_TENS)}, CAST(n % 100 // 10 AS INT) + 1) END, nullif(list_extract({_arr(numerals.ORDINAL_ONES)}, CAST(CASE WHEN n % 100 >= 20 THEN n % 10 ELSE n % 100 END AS INT) + 1), '')) AS word FROM (SELECT unnest(range(1, 1000)) AS n)")
def ordinal_table(spark: S, d: str) -> D:
    """Ordinals below 1000."""
    return spark.range(1, 1000).select(F.col("id").cast("int").alias("n"), numerals.ordinal_words(F.col("id")).alias("word"))


@query()
def ordinal_forms(spark: S, d: str) -> D:
    """Ordinals below 1000 in all cases, genders and numbers."""
    x = spark.range(1, 1000).select(F.col("id").cast("int").alias("n"), F.explode(numerals.ordinal_paradigm(F.col("id"))).alias("f"))
    return x.select("n", "f.*")


@query("SELECT doc_id, [CAST(strpos(text, 'obce') AS INT), CAST(strpos(CASE WHEN strpos(text, 'obce') > 0 THEN substr(text, 1, strpos(text, 'obce') - 1) || 'XXXX' || substr(text, strpos(text, 'obce') + 4) ELSE text END, 'obce') AS INT)] AS at FROM documents WHERE text IS NOT NULL")
def find_order(spark: S, d: str) -> D:
    """Where one item and its repetition stand, each hit masked before the next is looked for."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.find_order(F.col("text"), ["obce", "obce"]).alias("at"))


@query()
def rank_candidates(spark: S, d: str) -> D:
    """The spoken forms of a number nearest to what was heard, null from 10**12 on."""
    x = _transcripts(spark, d).where(F.col("gold").rlike(r"\d"))
    x = x.select("recording", "segment", "heard", F.explode(T.find_digits(F.col("gold"))).alias("n"))
    x = x.groupBy("recording", "segment", "heard", "n").agg(F.count("*").alias("times"))
    x = x.withColumn("variants", numerals.number_variants(_spelt("n")))
    return x.select("recording", "segment", "n", "times", align.ranked(F.col("variants"), F.col("heard"), 2, F.col("times")).alias("ranked"))
