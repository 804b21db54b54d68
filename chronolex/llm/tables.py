"""How the corpus tables are read by the queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segment_of(path: Column) -> Column:
    """``recording/segment`` of a frame path ``recording/segment/frame``."""
    return F.substring_index(path, "/", 2)


def frame_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1).try_cast("long")


def recording_in(*texts: Column) -> Column:
    """The first 16-digit recording id found in the given columns, else null."""
    found = [F.regexp_extract(t, r"(?<!\d)(\d{16})(?!\d)", 1) for t in texts]
    return F.coalesce(*(F.when(x != "", x) for x in found))
