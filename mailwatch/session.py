"""Session settings every job of this package expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # One clock for every timestamp column.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesced shuffles, size-checked broadcast, split hot join keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of raw messages must fit a Python worker: 500 messages, not the default 10,000 rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def build_session(app: str = "mailwatch", master: str | None = None, **conf) -> SparkSession:
    """A session with :data:`RUNTIME_CONF`; extra settings win over it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Sends raw messages to Python in batches no larger than this package's own sessions do, in any session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(RUNTIME_CONF[key])
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; in local mode a folder of its own will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="mailwatch-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; lost executors lose none of them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
