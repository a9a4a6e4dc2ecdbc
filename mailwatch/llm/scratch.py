"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a plan as soon as it has run, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Leaves a plan its stages. Those that it drops while they run would ask for files that are gone.
_EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"
_DROPS_STAGES = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode one of its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _run_once(spark: SparkSession) -> Iterator[None]:
    """Plans made and run in this block leave no shuffle files; the session's settings come back after it."""
    before = {c: spark.conf.get(c, None) for c in (_CLEANUP, _EXCLUDED)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_EXCLUDED, ",".join(filter(None, (before[_EXCLUDED], _DROPS_STAGES))))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def pinned(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in reliable storage; lost executors lose none of them.

    Nothing asks for the shuffle files behind them any more, so they go at once: a job of many steps holds those of one step.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    with _run_once(spark):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: a plan takes the setting when it is made


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The rows of df as a compressed Parquet table of the shared folder, and its path.

    Large intermediate tables take a fraction of the room of a checkpoint, and can be dropped as soon as their last reader is done.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
