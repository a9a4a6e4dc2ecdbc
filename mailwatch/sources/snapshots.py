"""The latest row of every key as a stored table that grows by upserts.

Rows lie in hash buckets of their key. An upsert reads and writes only the buckets that fresh rows touch; a version
names, for every bucket, the run whose files hold it. Versions are written last and whole, so a failed run changes
nothing, and readers of an older version keep their files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.latest import last_per_key

_VERSION = "version long, bucket int, run string, watermark timestamp"


@dataclass(frozen=True)
class Snapshot:
    """A snapshot under ``root``: one row per ``keys``, the one with the largest (``ts``, ``tie``), in ``buckets`` buckets."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    ts: str = "event_timestamp"
    tie: tuple[str, ...] = ()
    buckets: int = 64

    def _files(self):
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = jvm.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        jvm, system = self._files()
        folder = jvm.Path(f"{self.root}/versions")
        if not system.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in system.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> list:
        """(version, bucket, run, watermark) of the newest version, or of a given one; at most one row per bucket."""
        known = self._versions()
        if not known:
            return []
        path = f"{self.root}/versions/{version if version is not None else known[-1]}"
        return self.spark.read.schema(_VERSION).json(path).collect()

    def watermark(self):
        """The end of the last run, or None."""
        return max((r["watermark"] for r in self.manifest()), default=None)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, schema: T.StructType, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or of some."""
        rows = [r for r in self.manifest(version) if r["run"] and (buckets is None or r["bucket"] in buckets)]
        paths = [f"{self.root}/data/{r['run']}/bucket={r['bucket']}" for r in rows]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, features: DataFrame, end: Column) -> list[int]:
        """Merges the rows after the watermark and up to ``end``; returns the buckets that were written."""
        old, since = self.manifest(), self.watermark()
        moment = self.spark.range(1).select(end.cast("timestamp")).first()[0]
        fresh = features.where(F.col(self.ts).cast("timestamp") <= F.lit(moment))
        if since is not None:
            fresh = fresh.where(F.col(self.ts).cast("timestamp") > F.lit(since))
        # One row per key is all that can win; the smaller side of the merge is made once.
        order = [F.col(self.ts), *map(F.col, self.tie)]
        run = uuid.uuid4().hex
        staged = f"{self.root}/data/{run}-fresh"
        last_per_key(fresh, list(self.keys), order).withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(staged)
        jvm, system = self._files()
        touched = sorted(int(s.getPath().getName().removeprefix("bucket=")) for s in system.listStatus(jvm.Path(staged)) if s.getPath().getName().startswith("bucket="))
        if touched:
            new = self.spark.read.schema(features.schema).parquet(*[f"{staged}/bucket={b}" for b in touched])
            merged = last_per_key(self.read(features.schema, buckets=touched).unionByName(new), list(self.keys), order)
            merged.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.root}/data/{run}")
        system.delete(jvm.Path(staged), True)
        version = (old[0]["version"] if old else 0) + 1
        places = {r["bucket"]: r["run"] for r in old} | dict.fromkeys(touched, run)
        lines = [(version, b, places.get(b), max(filter(None, (since, moment)))) for b in range(self.buckets)]
        part = f"{self.root}/_open/{run}"
        self.spark.createDataFrame(lines, _VERSION).coalesce(1).write.json(part)
        system.mkdirs(jvm.Path(f"{self.root}/versions"))
        place = jvm.Path(f"{self.root}/versions/{version}")
        if system.exists(place) or not system.rename(jvm.Path(part), place):
            raise RuntimeError(f"version {version} was written by another run")
        return touched
