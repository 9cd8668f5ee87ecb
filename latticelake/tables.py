"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder of its own; on a
    cluster that would not be shared, so a missing setting is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="latticelake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there: this cuts the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def _paths(spark: SparkSession, pattern: str):
    """Hadoop's file system of a path, and the paths that a pattern matches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, [x.getPath() for x in system.globStatus(path) or []]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_paths(spark, path)[1])


def make_dir(spark: SparkSession, path: str) -> None:
    _paths(spark, path)[0].mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def remove(spark: SparkSession, pattern: str) -> None:
    """Deletes the folders and files that match a pattern, if any."""
    system, found = _paths(spark, pattern)
    for x in found:
        system.delete(x, True)
