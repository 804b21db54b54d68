"""Transcripts into clean speaker turns: problem 7.

Tokens are ordered by time inside their segment. Hesitations, sound notes (in one token or spread
over several) and clock stamps are no words. Words carry the speaker of their label, else of the
word before, else the first speaker named in the segment; a change of speaker opens a turn.

A segment is cut into time shards so that a very long one is many tasks. The tokens are sorted once by
(segment, shard, time) and streamed through one pass that settles all that a shard can know by
itself. What it cannot know (a note opened before it or closed behind it, who spoke last) touches
the words before its first event and behind its last one, and the first words of what follows;
each shard leaves one summary row for these. Windows over the summaries say what lies around a
shard, and one join brings that to the words it concerns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.speakers import resolve_labels
from chronolex.shared import materialise

SHARD = 120.0
#: Signs that open and close notes.
OPEN, CLOSE = "([{<*", ")]}>*"
_END = r"[\s.,;:?!…]*$"
HESITATION = r"^(?:e+h*m*|(?:aa+|oo+|uu+)h*m*|[aou]h+m*|m*h+m+|mm+|[aou]mm+)$"
STAMP = r"^[(\[{<*]*\d{1,3}(?::\d{1,2}){1,2}(?:[.,]\d+)?[)\]}>*]*[.,;?!…]*$"
MARK = r"^<\s*[^<>\d]*=\s*[^<>]*>[.,;?!…]*$"
NUMBER = r"^[(\[{<*]+\s*\d+(?:[.,]\d+)*\s*[.]?[)\]}>*]+[.,;:?!…]*$"


def classified(word: Column) -> tuple[Column, Column]:
    """Whether a token may be a word, and its event: k > 0 a note of kind k opens, -k it closes, 0 neither."""
    t = F.trim(word)
    bare = F.regexp_replace(F.lower(F.translate(t, "éÉěĚ", "eeee")), r"[^\p{L}\p{N}]", "")
    head, tail = F.substring(t, 1, 1), F.regexp_extract(t, r"([)\]}>*])[.,;:?!…]*$", 1)
    opens = F.length(head).eqNullSafe(1) & F.lit(OPEN).contains(head)
    closes = tail != ""
    one = opens & closes & (F.length(F.regexp_replace(t, r"[^()\[\]{}<>*]", "")) >= 2)
    special = t.rlike(STAMP) | t.rlike(MARK)
    number = t.rlike(NUMBER) & ~special
    word_like = ~special & ~((bare.rlike(HESITATION)) & ~number) & (~one | number) & t.rlike(r"\S")
    kind = F.translate(F.when(opens, head).otherwise(tail), "([{<*)]}>", "12345" + "1234").cast("int")
    event = F.when(one | special | number, 0).when(opens, kind).when(closes, -kind).otherwise(0)
    return F.coalesce(word_like, F.lit(False)), F.coalesce(event, F.lit(0))


#: What a word's being one depends on: events before its shard (BEFORE, and FIRST for the closing sign that
#: is the first event), nothing, events behind (BEHIND), or both, in a shard without any (BOTH).
BEFORE, FIRST, SETTLED, BEHIND, BOTH = range(5)
#: Whether a word opens a turn: no, yes, or only its surroundings can tell.
NO, YES, OPEN_QUESTION = range(3)
_NOBODY = np.iinfo(np.int64).min
_LOCAL = "segm string, shard long, at int, start double, word string, own int, class int, lead boolean, opens int, info array<long>"


def _filled(values: np.ndarray, known: np.ndarray, begin: np.ndarray, none: int) -> np.ndarray:
    """The last known value at or before each row, from its group's begin on, else ``none``."""
    last = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(last >= begin, values[last], none)


def _settle(t: pa.Table, keep_words: bool) -> pa.RecordBatch:
    """Rows of whole, sorted shards: their words, then a summary row (at -1) for each shard."""
    n = t.num_rows
    column = lambda name: t.column(name).combine_chunks()
    segm, shard = column("segm"), column("shard").to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (shard[1:] != shard[:-1]) | pc.not_equal(segm.slice(1), segm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    group = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    begin = firsts[group]
    end = np.append(firsts[1:], n)[group]
    e = column("event").to_numpy(zero_copy_only=False).astype(np.int64)
    named = column("named").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = np.where(column("named").is_null().to_numpy(zero_copy_only=False), _NOBODY, named)

    upto = _filled(e, e != 0, begin, 0)
    was = np.where(np.arange(n) > begin, np.append(0, upto[:-1]), 0)
    later = np.minimum.accumulate(np.where(e != 0, np.arange(n), n)[::-1])[::-1]
    later = np.append(later[1:], n)
    behind = np.where(later < end, e[np.minimum(later, n - 1)], 0)
    noted = ((upto > 0) & (behind == -upto)) | ((e < 0) & (was == -e))  # a star opens as it closes: the second of two is the end of the first
    kind = np.select([(e < 0) & (was == 0), (upto == 0) & (behind != 0), upto == 0, behind == 0], [FIRST, BEFORE, BOTH, BEHIND], SETTLED)

    w = np.flatnonzero(column("maybe").to_numpy(zero_copy_only=False) & ~noted)
    g, k, who = group[w], kind[w], named[w]
    part = np.select([(k == BEFORE) | (k == BOTH), k == FIRST], [0, 1], 2)
    lead = np.ones(len(w), bool)
    lead[1:] = (g[1:] != g[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(w) else w
    own = _filled(who, who != _NOBODY, starts, _NOBODY) if len(w) else who
    prev = np.where(lead, _NOBODY, np.append(_NOBODY, own[:-1])) if len(w) else own
    opens = np.select([lead, own == _NOBODY, prev == _NOBODY], [OPEN_QUESTION, NO, OPEN_QUESTION], (own != prev).astype(int))
    at = np.arange(len(w)) - np.searchsorted(g, g)

    info = np.full((len(firsts), 17), _NOBODY)
    info[:, 0] = e[np.minimum(np.where(e[firsts] != 0, firsts, later[firsts]), n - 1)] * (np.where(e[firsts] != 0, firsts, later[firsts]) < end[firsts])
    info[:, 1] = upto[np.append(firsts[1:], n) - 1]
    for c in range(5):
        mine = np.flatnonzero(k == c)
        info[:, 2 + 3 * c] = 0
        info[g[mine], 2 + 3 * c] = 1
        mine = mine[who[mine] != _NOBODY]
        gs, at_first = np.unique(g[mine], return_index=True)
        info[gs, 3 + 3 * c] = who[mine[at_first]]
        info[gs, 4 + 3 * c] = who[mine[np.append(at_first[1:], len(mine)) - 1]] if len(gs) else 0

    rows, none = len(w), len(firsts)
    take = pa.array(np.append(w, firsts))
    only = lambda v, typ, mask=None: pa.concat_arrays([pa.array(v, typ, mask=mask), pa.nulls(none, typ)])
    listed = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(rows), np.arange(none + 1) * 17).astype(np.int32)), pa.array(info.ravel(), mask=info.ravel() == _NOBODY))
    words = pa.concat_arrays([column("word").take(pa.array(w)), pa.nulls(none, pa.string())]) if keep_words else pa.nulls(rows + none, pa.string())
    begins = pa.concat_arrays([column("start").take(pa.array(w)), pa.nulls(none, pa.float64())])
    return pa.RecordBatch.from_arrays(
        [segm.take(take), pa.array(np.append(shard[w], shard[firsts])), pa.array(np.append(at, np.full(none, -1)), pa.int32()), begins, words, only(own, pa.int32(), own == _NOBODY), only(k, pa.int32()), only(lead, pa.bool_()), only(opens, pa.int32()), listed],
        names=["segm", "shard", "at", "start", "word", "own", "class", "lead", "opens", "info"],
    )


def _stream(keep_words: bool):
    """The pass over sorted tokens; only the rows of one shard are held back from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            same = pc.and_(pc.equal(b.column("segm"), b.column("segm")[-1]), pc.equal(b.column("shard"), b.column("shard")[-1]))
            cut = int(np.argmax(same.to_numpy(zero_copy_only=False)))  # where the batch's last shard begins
            if cut == 0 and held and (held[-1].column("segm")[-1], held[-1].column("shard")[-1]) == (b.column("segm")[-1], b.column("shard")[-1]):
                held.append(b)
                continue
            done = pa.Table.from_batches([*held, b.slice(0, cut)]) if held or cut else None
            if done is not None and done.num_rows:
                yield _settle(done, keep_words)
            held = [b.slice(cut)]
        if held:
            yield _settle(pa.Table.from_batches(held), keep_words)

    return run


def _surroundings(local: DataFrame) -> DataFrame:
    """(__s, __h, ok array, fill array, inside, before): what lies around each shard, a row a shard.

    ``ok`` says of each class whether its words are words; ``fill`` is the speaker that words of
    the first, second and third part of the shard have without a named one in their part; ``inside`` says
    whether there are words in the first and the first two parts; ``before`` is the last speaker before
    the shard, null where no word lies there.
    """
    at = lambda c, i: F.col("info")[2 + 3 * c + i]
    x = local.where("at = -1").select("segm", "shard", "info", F.nullif(F.col("info")[0], F.lit(0)).alias("e1"), F.nullif(F.col("info")[1], F.lit(0)).alias("e2"))
    up = Window.partitionBy("segm").orderBy("shard")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("segm").orderBy(F.col("shard").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("eb", F.coalesce(F.last("e2", True).over(before), F.lit(0))).withColumn("ea", F.coalesce(F.last("e1", True).over(down), F.lit(0)))
    e1, e2, eb, ea = (F.coalesce(F.col(c), F.lit(0)) for c in ("e1", "e2", "eb", "ea"))
    ok = {BEFORE: ~((eb > 0) & (e1 == -eb)), FIRST: ~((eb > 0) & (e1 == -eb)), SETTLED: F.lit(True), BEHIND: ~((e2 > 0) & (ea == -e2)), BOTH: ~((eb > 0) & (ea == -eb))}
    x = x.withColumn("ok", F.array(*(ok[c] for c in range(5))))
    good = lambda c, i: F.when(F.col("ok")[c], at(c, i))
    order = (BEFORE, BOTH, FIRST, SETTLED, BEHIND)
    x = x.withColumn("s1", F.coalesce(*(good(c, 1) for c in order))).withColumn("s2", F.coalesce(*(good(c, 2) for c in reversed(order))))
    x = x.withColumn("has", F.greatest(*(F.coalesce(good(c, 0), F.lit(0)) for c in order)))
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("base", F.coalesce(F.last("s2", True).over(before), F.first("s1", True).over(whole)))
    x = x.withColumn("later", F.coalesce(F.max("has").over(before), F.lit(0)) > 0)
    one = F.coalesce(good(BEFORE, 2), good(BOTH, 2), F.col("base"))
    two = F.coalesce(good(FIRST, 2), one)
    some = F.greatest(F.coalesce(good(BEFORE, 0), F.lit(0)), F.coalesce(good(BOTH, 0), F.lit(0)))
    more = F.greatest(some, F.coalesce(good(FIRST, 0), F.lit(0)))
    return x.select(F.col("segm").alias("__s"), F.col("shard").alias("__h"), "ok", F.array("base", one, two).alias("fill"), F.array(F.lit(False), some > 0, more > 0).alias("inside"), F.when(F.col("later"), F.col("base")).alias("before"))


def _answered(rows: DataFrame, around: DataFrame) -> DataFrame:
    """``rows`` of the local pass with speaker_id and opens, those that are no words left out."""
    x = rows.join(around, (F.col("segm") == F.col("__s")) & (F.col("shard") == F.col("__h"))).where(F.col("ok")[F.col("class")])
    part = F.when(F.col("class").isin(BEFORE, BOTH), 0).when(F.col("class") == FIRST, 1).otherwise(2)
    x = x.withColumn("part", part).withColumn("speaker_id", F.coalesce(F.col("own"), F.col("fill")[F.col("part")]).cast("int"))
    last = F.when(F.col("lead") & ~F.col("inside")[F.col("part")], F.col("before")).otherwise(F.col("fill")[F.col("part")])
    asked = F.col("speaker_id").isNotNull() & ~F.col("speaker_id").cast("long").eqNullSafe(last)
    x = x.withColumn("opens", F.when(F.col("opens") == OPEN_QUESTION, asked).otherwise(F.col("opens") == YES))
    return x.select("segm", "shard", "at", "start", "word", "speaker_id", "opens")


def _local(df: DataFrame, roster: DataFrame, *, segment: Column, word: Column, speaker: Column, start: Column, end: Column, tie: Column, transcript: Column, shard: float, keep_words: bool) -> DataFrame:
    x = df.select(segment.cast("string").alias("segm"), word.cast("string").alias("word"), speaker.cast("string").alias("label"), start.cast("double").alias("start"), end.cast("double").alias("end"), tie.cast("string").alias("tie"), transcript.cast("string").alias("transcript"))
    x = x.where("segm is not null and start is not null and not isnan(start) and word is not null")
    names = resolve_labels(x, roster, transcript=F.col("transcript"), label=F.col("label"))
    names = materialise(names.select(F.col("transcript").alias("nt"), F.col("label").alias("nl"), F.col("speaker_id")), "names")
    x = x.distinct()
    x = x.join(names.where("nt is null").select("nl", F.col("speaker_id").alias("sure")), F.col("label") == F.col("nl"), "left").drop("nl")
    x = x.join(names.where("nt is not null").select("nt", F.col("nl"), F.col("speaker_id").alias("here")), (F.col("label") == F.col("nl")) & (F.col("transcript") == F.col("nt")), "left").drop("nl", "nt")
    maybe, event = classified(F.col("word"))
    x = x.select("segm", F.floor(F.col("start") / shard).alias("shard"), "start", F.coalesce(F.col("end"), F.lit(float("inf"))).alias("end"), F.coalesce("tie", F.lit("~")).alias("tie"), "word", maybe.alias("maybe"), event.alias("event"), F.coalesce("sure", "here").alias("named"))
    x = x.repartition("segm", "shard").sortWithinPartitions("segm", "shard", "start", "end", "tie", "word", "named")
    return materialise(x.mapInArrow(_stream(keep_words), _LOCAL), "settled")


def spoken_words(df: DataFrame, roster: DataFrame, *, segment: Column, word: Column, speaker: Column, start: Column, end: Column, tie: Column, transcript: Column, shard: float = SHARD) -> DataFrame:
    """(segm, shard, at, start, word, speaker_id, opens): the words with their resolved speaker.

    ``at`` is the place among the words of the shard. ``opens`` marks the first word of a turn.
    Repeated rows count once. Tokens without a start have no place and are left out, like those of a
    null segment; NaN is no time. Equal starts go by end, ``tie`` and the word. Words of a segment
    in which nobody is named have no speaker and open no turn.
    """
    x = _local(df, roster, segment=segment, word=word, speaker=speaker, start=start, end=end, tie=tie, transcript=transcript, shard=shard, keep_words=True)
    return _answered(x.where("at >= 0"), _surroundings(x))


def turn_starts(df: DataFrame, roster: DataFrame, *, segment: Column, word: Column, speaker: Column, start: Column, end: Column, tie: Column, transcript: Column, shard: float = SHARD) -> DataFrame:
    """The rows of ``spoken_words`` that open a turn, without the word; words that cannot are not joined."""
    x = _local(df, roster, segment=segment, word=word, speaker=speaker, start=start, end=end, tie=tie, transcript=transcript, shard=shard, keep_words=False)
    return _answered(x.where(f"at >= 0 and opens <> {NO}"), _surroundings(x)).where("opens").drop("word")


def turns(words: DataFrame) -> DataFrame:
    """(segm, turn, speaker_id, start, words, text) from ``spoken_words``; turns count from 0."""
    x = materialise(words.where("speaker_id is not null"), "words")
    opened = x.groupBy("segm", "shard").agg(F.sum(F.col("opens").cast("long")).alias("n"))
    before = Window.partitionBy("segm").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = opened.select(F.col("segm").alias("__s"), F.col("shard").alias("__h"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    x = x.join(base, (F.col("segm") == F.col("__s")) & (F.col("shard") == F.col("__h"))).drop("__s", "__h")
    up = Window.partitionBy("segm", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("turn", F.col("base") + F.sum(F.col("opens").cast("long")).over(up) - 1)
    # the words of a shard become one text first, so no list holds more than a shard's words and a turn's texts
    x = x.groupBy("segm", "turn", "speaker_id", "shard").agg(F.min("start").alias("start"), F.count("*").alias("words"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    x = x.withColumn("w", F.array_join(F.transform("w", lambda s: s["word"]), " "))
    x = x.groupBy("segm", "turn", "speaker_id").agg(F.min("start").alias("start"), F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("shard", "w"))).alias("w"))
    return x.withColumn("text", F.array_join(F.transform("w", lambda s: s["w"]), " ")).drop("w")
