"""Sources mixed to target weights: problem 9.

A schedule of slots, each of one block of tokens, is laid out by a low-discrepancy sequence: slot
i takes the source under the point frac((i + 1/2) * golden ratio) of the cumulative weights, so
every stretch of the schedule has the shares of the whole. The slots of a source are ranked; the
documents of a source, shuffled anew for each repetition, are cut by a running token count into
blocks of equal size; slot r of a source takes its block r. Where a source has no block left,
repetitions used up, the slot stays empty and the report says so.

Ranks and running counts are made in buckets, so a source with most of the documents or slots is
many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.llm.ranks import running
from chronolex.shared import materialise

BLOCK = 2048
GOLDEN = (math.sqrt(5) - 1) / 2
CHUNK = 1 << 16
MOST_SOURCES = 1_000
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Mix:
    """``records`` (slot, source, key, repetition, size) and ``report``, a row a source."""

    records: DataFrame
    report: DataFrame


def schedule(spark: SparkSession, targets: list[tuple[str, float, int]], slots: int) -> DataFrame:
    """(slot, source, rank): rank counts the slots of a source from 0."""
    whole = sum(t for _, t, _ in targets)
    point = (F.col("id") + 0.5) * GOLDEN
    point = point - F.floor(point)
    cuts, upto = [], 0.0
    for s, t, _ in targets:
        upto += t / whole
        cuts.append((s, upto))
    source = F.lit(targets[-1][0])
    for s, cut in reversed(cuts[:-1]):
        source = F.when(point < cut, F.lit(s)).otherwise(source)
    x = spark.range(slots).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    return running(x, ["source"], "chunk", ["slot"], name="rank").drop("chunk")


def mix(df: DataFrame, *, key: Column, source: Column, size: Column, targets: DataFrame, block: int = BLOCK, seed: int = 0, total: int | None = None) -> Mix:
    """Mix the documents of ``df`` to the shares of ``targets`` (source, target_share, max_repeats).

    ``total`` is the size of the mixture, by default that of all documents. Sources are compared
    trimmed and in lower case. Documents of a null source, or of one without target, are in the
    total but not in the mixture; a null or non-positive size is 0, such documents are left out
    of the mixture. Targets of a null or non-positive share take no slot; a null max_repeats is 1.
    Repeated rows count as often as they occur. An empty table gives an empty mixture and a report
    in which every source with a target falls short of nothing.

    Report: source, target_share, max_repeats, documents, tokens, wanted (target_share of the
    total), slots, reach (blocks of the source, all the repetitions it is allowed and needs), filled (slots
    its blocks reach), mixed (tokens in the mixture), available (tokens times max_repeats),
    actual_share (of the mixture), share_of_total (mixed over the wanted total: what target_share
    speaks of), repeated (mixed over tokens), short. A document larger than a block fills the slots of all
    blocks it reaches into.

    A source is short when the schedule has slots for which it has no block left, repetitions
    used up. A block is a unit too coarse to tell by alone, and the slots of a source are its share
    only up to the discrepancy of the sequence: where blocks and slots differ by less than
    ``slack`` (2 and the binary digits of the slots), available < wanted settles it.
    """
    spark = df.sparkSession
    given = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    rows = [tuple(r) for r in given.where("source is not null and target_share > 0").orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    if not rows:
        raise ValueError("no source has a target")
    docs = df.select(key.alias("key"), F.lower(F.trim(source)).alias("source"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    docs = materialise(docs.withColumn("id", F.monotonically_increasing_id()), "sized")
    have = {r["source"]: (r["n"], r["t"]) for r in docs.join(F.broadcast(given.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("t")).collect()}
    total = total if total is not None else (docs.agg(F.sum("size")).first()[0] or 0)
    slots = math.ceil(total / block)
    slack = 2 + slots.bit_length()
    whole = sum(t for _, t, _ in rows)
    times = [(s, min(m, math.ceil(t / whole * total / have[s][1]) + 1), have[s][1]) for s, t, m in rows if have.get(s, (0, 0))[1]]
    schema = "source string, times int, stock long"
    needed = spark.createDataFrame(times, schema)
    most = max((n * m for n, m in ((have[s][0], m) for s, m, _ in times)), default=1)
    shift = 64 - min(30, max(1, math.ceil(math.log2(most / BUCKET_ROWS + 1))))  # buckets of about BUCKET_ROWS rows

    plan = schedule(spark, rows, slots)
    x = docs.where("size > 0").join(F.broadcast(needed), "source")
    x = x.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    x = x.withColumn("h", F.xxhash64(F.lit(seed), "repetition", "id")).withColumn("bucket", F.shiftright("h", shift))
    x = running(x, ["source", "repetition"], "bucket", ["h", "id"], size="size", name="offset")
    x = x.withColumn("at", F.col("offset") + F.col("repetition") * F.col("stock"))
    x = x.select("source", "key", "repetition", "size", "at", F.floor(F.col("at") / block).alias("rank"))
    placed = x.join(plan, ["source", "rank"], "left").select("slot", "source", "key", "repetition", "size", "at")
    placed = materialise(placed, "mixture")  # a block beyond the last slot of its source has no slot
    records = placed.where("slot is not null")
    upto = F.floor((F.col("at") + F.col("size") - 1) / block) + 1  # blocks are covered without holes
    filled = placed.groupBy("source").agg(F.max(upto).alias("reach"), F.sum(F.when(F.col("slot").isNotNull(), F.col("size"))).alias("mixed"))
    wanted = plan.groupBy("source").agg(F.count("*").alias("slots"))
    facts = spark.createDataFrame([(s, t, m, *have.get(s, (0, 0)), t / whole * total) for s, t, m in rows], "source string, target_share double, max_repeats int, documents long, tokens long, wanted double")
    report = facts.join(wanted, "source", "left").join(filled, "source", "left").fillna(0, ["slots", "reach", "mixed"])
    report = report.withColumn("filled", F.least("slots", "reach"))
    report = report.withColumn("available", F.col("tokens") * F.col("max_repeats"))
    everything = F.sum("mixed").over(Window.partitionBy(F.lit(1)))  # one row a source
    report = report.withColumns({
        "actual_share": F.when(everything > 0, F.col("mixed") / everything).otherwise(0.0),
        "repeated": F.when(F.col("tokens") > 0, F.col("mixed") / F.col("tokens")).otherwise(0.0),
        "share_of_total": F.when(F.lit(total) > 0, F.col("mixed") / F.lit(total)).otherwise(0.0),
        "short": F.when(F.abs(F.col("slots") - F.col("reach")) < slack, F.col("available") < F.col("wanted")).otherwise(F.col("slots") > F.col("reach")),
    })
    return Mix(records.drop("at"), report)
