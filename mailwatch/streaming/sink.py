"""Continuous inference-log sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..schema import LOG_PARTITIONS
from ..sources.logs import with_partitions


def log_stream(records: DataFrame, path: str, checkpoint: str, every: str = "60 seconds", once: bool = False) -> DataStreamWriter:
    """File sink by hour: the checkpoint makes each micro-batch exactly-once across retries.

    ``once`` drains what is available and stops.
    """
    writer = (
        with_partitions(records)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("compression", "snappy")
        .partitionBy(*LOG_PARTITIONS)
        .outputMode("append")
    )
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def guarded_log_stream(
    records: DataFrame, path: str, dead_letters: str, checkpoint: str, write=None, every: str = "60 seconds", once: bool = False
) -> DataStreamWriter:
    """Log sink with a fallback: a batch whose write fails twice goes to ``dead_letters``.

    Batches overwrite their own batch directory, so a replay after a lost executor or
    driver does not duplicate rows. If the fallback fails too, the query fails.
    """
    from pyspark.sql import functions as F

    def default_write(batch: DataFrame, batch_id: int) -> None:
        with_partitions(batch).write.mode("overwrite").partitionBy(*LOG_PARTITIONS).parquet(f"{path}/batch={batch_id}")

    target = write or default_write

    def handle(batch: DataFrame, batch_id: int) -> None:
        error = None
        for _ in range(2):
            try:
                target(batch, batch_id)
                return
            except Exception as e:  # retried once, then diverted
                error = str(e).splitlines()[0][:500]
        batch.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")

    writer = records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
