"""Streaming forms of the event aggregations; each has the same meaning over a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.shared import fresh_path


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and sum per key and fixed window; events later than ``late`` are dropped from a stream."""
    x = df.withWatermark(time, late) if late and df.isStreaming else df
    return _flat(x.groupBy(F.window(time, width).alias("w"), *keys), keys, value)


def sliding(df: DataFrame, time: str, width: str, slide: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """As ``tumbling``, for windows that overlap."""
    x = df.withWatermark(time, late) if late and df.isStreaming else df
    return _flat(x.groupBy(F.window(time, width, slide).alias("w"), *keys), keys, value)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """As ``tumbling``, for stretches without a pause longer than ``gap``."""
    x = df.withWatermark(time, late) if late and df.isStreaming else df
    return _flat(x.groupBy(F.session_window(time, gap).alias("w"), *keys), keys, value)


def _flat(grouped, keys: list[str], value: str) -> DataFrame:
    x = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return x.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key, state kept for ``late``."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_lengths(df: DataFrame, key: str, time: str, value: Column, schema_time: str = "timestamp") -> DataFrame:
    """Runs of equal values per key of a stream, emitted when they end: (key, value, start, end, n).

    State per key is the open run alone. Events of a batch are taken in order of time.
    """
    x = df.select(F.col(key).cast("string").alias("key"), F.col(time).cast(schema_time).alias("time"), value.cast("string").alias("value"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = []
        run = list(state.get) if state.exists else None
        events = pd.concat(list(batches), ignore_index=True).sort_values(["time", "value"])
        for t, v in zip(events["time"], events["value"]):
            if run is not None and run[0] == v:
                run[2], run[3] = t, run[3] + 1
            else:
                if run is not None:
                    rows.append((key[0], *run))
                run = [v, t, t, 1]
        if run is not None:
            state.update(tuple(run))
        yield pd.DataFrame(rows, columns=["key", "value", "start", "end", "n"])

    fields = f"value string, start {schema_time}, end {schema_time}, n long"
    return x.groupBy("key").applyInPandasWithState(step, f"key string, {fields}", fields, "append", "NoTimeout")


def drain(spark: SparkSession, df: DataFrame, mode: str = "complete", state: str | None = None) -> DataFrame:
    """Run a streaming query over all that is there, to a table in the shared folder.

    Each batch has a folder of its own that a replay writes over, so no row comes twice.
    ``state`` is the checkpoint's folder, a new one if none is given.
    """
    path, state = fresh_path(spark, "stream"), state or fresh_path(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/__batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if mode != "complete" and not q.lastProgress:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def drained_runs(spark: SparkSession, events: DataFrame, key: str, time: str, value: Column) -> DataFrame:
    """``run_lengths`` of a stream run to its end: the runs that ended, and those its state still holds open."""
    state = fresh_path(spark, "state")
    runs = run_lengths(events, key, time, value)
    ended = drain(spark, runs, "append", state)
    held = spark.read.format("statestore").load(state)
    run = "value.groupState" if "groupState" in held.schema["value"].dataType.fieldNames() else "value"
    return ended.unionByName(held.select(F.col("key.key").alias("key"), *(F.col(f"{run}.{c}").alias(c) for c in ("value", "start", "end", "n"))))


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, given as one file or as a folder of files, read as a stream."""
    place = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(place).schema)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(place)
