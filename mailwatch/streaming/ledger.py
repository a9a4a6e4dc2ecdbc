"""A log sink that writes every batch once, whatever is repeated, and loses none.

Each try at a batch writes to a folder of its own; the batch counts only once its line stands in the manifest. A batch
that is already there is not written again, and what a failed or repeated try left behind is never read. A batch whose
log cannot be written goes to the dead letters with the reason, under the same manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..sources.logs import with_partitions

_MANIFEST = "batch_id long, attempt string, state string, n long, error string"

Write = Callable[[DataFrame, str], None]


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "snappy").parquet(path)


class Ledger:
    """The folders of one sink: log, dead letters and manifest."""

    def __init__(self, spark: SparkSession, root: str, tries: int = 2, write: Write = _write):
        self.spark, self.root, self.tries, self.write = spark, root.rstrip("/"), tries, write

    def manifest(self) -> DataFrame:
        """One row per finished batch: (batch_id, attempt, state, n, error); state is stored or dead."""
        path = f"{self.root}/manifest"
        if not self._exists(path):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json(path, recursiveFileLookup=True)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        found = jvm.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def _commit(self, batch_id: int, attempt: str, state: str, n: int, error: str | None) -> None:
        """The manifest line appears whole or not at all: its folder is named only when it is written."""
        line = self.spark.createDataFrame([(batch_id, attempt, state, n, error)], _MANIFEST).coalesce(1)
        part = f"{self.root}/_open/{attempt}"
        line.write.json(part)
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        system = jvm.Path(part).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(jvm.Path(f"{self.root}/manifest"))
        place = f"{self.root}/manifest/batch-{batch_id}"
        if self._exists(place) or not system.rename(jvm.Path(part), jvm.Path(place)):
            raise RuntimeError(f"batch {batch_id} was finished by another run")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Writes a batch unless it is done: to the log, else to the dead letters; fails only if neither can be written."""
        if self._exists(f"{self.root}/manifest/batch-{batch_id}"):
            return
        rows, error = with_partitions(batch).withColumn("batch_id", F.lit(batch_id).cast("long")), None
        for folder in ["log"] * self.tries + ["dead"]:
            attempt, seen = uuid.uuid4().hex, Observation()
            own = rows.withColumns({"attempt": F.lit(attempt), "error": F.lit(error).cast("string")})
            counted = own.observe(seen, F.count(F.lit(1)).alias("n"))
            try:
                (self.write if folder == "log" else _write)(counted, f"{self.root}/{folder}/batch={batch_id}/{attempt}")
            except Exception as e:
                if folder == "dead":
                    raise
                error = (str(e) or type(e).__name__).splitlines()[0][:500]
                continue
            self._commit(batch_id, attempt, "stored" if folder == "log" else "dead", seen.get["n"], error)
            return

    def _read(self, folder: str, state: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([*with_partitions(self.spark.createDataFrame([], schema)).schema.fields, T.StructField("batch_id", T.LongType()),
                             T.StructField("attempt", T.StringType()), T.StructField("error", T.StringType())])
        path = f"{self.root}/{folder}"
        if not self._exists(path):
            return self.spark.createDataFrame([], full)
        done = self.manifest().where(F.col("state") == state).select("batch_id", "attempt")
        return self.spark.read.schema(full).option("recursiveFileLookup", True).parquet(path).join(done, ["batch_id", "attempt"], "left_semi")

    def log(self, schema: T.StructType) -> DataFrame:
        """The rows of all stored batches, each once."""
        return self._read("log", "stored", schema).drop("attempt", "error")

    def dead_letters(self, schema: T.StructType) -> DataFrame:
        """The rows of batches that the log could not take, with the reason."""
        return self._read("dead", "dead", schema).drop("attempt")


def ledger_stream(records: DataFrame, ledger: Ledger, checkpoint: str, every: str = "60 seconds", once: bool = False) -> DataStreamWriter:
    """Feeds the ledger batch by batch. ``once`` drains what is available and stops."""
    writer = records.writeStream.foreachBatch(ledger.take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
