"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; if unset, a folder below the warehouse in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; it is deleted when the process ends."""
    path = f"{shared_folder(spark)}/riskloom/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_at_exit, spark)
    _paths.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as Parquet and go on from the written table.

    Later passes read only the columns they need, and a lost executor costs a re-read, not
    the whole lineage.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no frame still to be computed reads."""
    for df in frames:
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            _delete(spark, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table this process has staged; frames that read them end here."""
    while _paths:
        _delete(spark, _paths.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession) -> None:
    """Best effort: a driver that was killed leaves its folder to whoever owns the checkpoints."""
    if spark.sparkContext._jsc is not None:
        release_all(spark)
