"""Drift-report history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """Appends report rows, partitioned by model and day."""
    reports.withColumn("report_date", F.to_date("generated_at")).write.mode("append").partitionBy(
        "model_name", "report_date"
    ).parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recent_reports(reports: DataFrame, today: Column, days: int = 7, day: Column | None = None) -> DataFrame:
    """Reports of the last ``days`` calendar days, newest first."""
    day = day if day is not None else F.to_date("generated_at")
    return reports.where((day > F.date_sub(today, days)) & (day <= today)).orderBy(
        F.col("generated_at").desc(), F.col("report_id").desc()
    )
