"""Tables cut from their lineage, written to the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the session
runs on one machine, one is made and removed at exit; a cluster without
the setting raises.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    given = _configured(spark)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = own_folder()
    return _LOCAL[app]


def own_folder() -> str:
    """A new folder on this machine for a session that runs on it alone, removed at exit."""
    path = tempfile.mkdtemp(prefix="chronolex-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/chronolex/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the session's own part of the shared folder that nothing else uses."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all tables of this session; results that still read them are lost."""
    remove(spark, _own(spark))


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write once, read back: the result survives lost executors and is never computed twice."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
