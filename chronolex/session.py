"""Session builder and the few settings every entry point relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from chronolex.shared import own_folder


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, ANSI, AQE on.

    The shared folder is ``CHRONOLEX_SHARED_DIR``, else a new one on this machine.
    """
    shared = os.environ.get("CHRONOLEX_SHARED_DIR")
    if shared is None and SparkSession.getActiveSession() is None:
        shared = own_folder()
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cores}]")
        .appName("chronolex")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CHRONOLEX_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
