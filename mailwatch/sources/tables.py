"""Parquet tables: projected scans, feature sinks, baselines and fitted artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EMAILS


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan of the named columns only."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).select(*columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when a scan has fewer splits than cores (one small file).

    A scan with enough splits is returned as it is: no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def write_emails(emails: DataFrame, path: str) -> None:
    """One directory per label; reading the root gives the combined table."""
    emails.hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(path)


def read_emails(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    df = spark.read.schema(EMAILS).parquet(path)
    return df if label is None else df.where(F.col("label") == label)


def write_features(df: DataFrame, path: str, key: str) -> None:
    """Feature sink, rows of one key kept together; oversized keys are split by the rebalance."""
    df.hint("rebalance", key).write.mode("overwrite").parquet(path)


BASELINE_KEYS = ["model_name", "model_version"]


def save_baseline(table: DataFrame, path: str) -> None:
    """Appends one baseline version; the table carries model_name, model_version, created_at."""
    table.write.mode("append").partitionBy(*BASELINE_KEYS).parquet(path)


def load_baseline(spark: SparkSession, path: str, model_name: str, model_version: str | None = None) -> DataFrame:
    """A named version, or the one created last. Only its partition is read."""
    df = spark.read.parquet(path).where(F.col("model_name") == model_name)
    if model_version is None:
        newest = df.agg(F.max_by("model_version", "created_at")).scalar()
        return df.where(F.col("model_version") == newest)
    return df.where(F.col("model_version") == model_version)


def save_artifact(df: DataFrame, path: str) -> None:
    """Fitted state small by construction (vocabulary, scaler): one file."""
    # repartition, so that the plan behind df keeps its own parallelism.
    df.repartition(1).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
