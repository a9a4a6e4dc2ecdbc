"""The hour-partitioned inference log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INFERENCE_LOG, LOG_PARTITIONS


def with_partitions(log: DataFrame) -> DataFrame:
    """Adds zero-padded year/month/day/hour of each row's own timestamp."""
    patterns = dict(zip(LOG_PARTITIONS, ("yyyy", "MM", "dd", "HH")))
    return log.withColumns({c: F.date_format("timestamp", p) for c, p in patterns.items()})


def log_rows(
    scored: DataFrame, features: Sequence[str], model_name: str, model_version: str, timestamp: Column,
    inference_id: Column, latency_ms: Column, api_version: str = "1.0.0", environment: str = "production",
) -> DataFrame:
    """Log rows of a scoring: raw (unscaled) features as one JSON map; NULL ids become ''."""
    empty = F.lit("")
    present = lambda c: F.coalesce(F.col(c), empty) if c in scored.columns else empty
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))
    return scored.select(
        inference_id.alias("inference_id"),
        timestamp.alias("timestamp"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        F.col("prediction_label").alias("prediction"),
        "spam_probability",
        latency_ms.cast("double").alias("latency_ms"),
        F.lit(api_version).alias("api_version"),
        F.lit(environment).alias("environment"),
        present("email_id").alias("email_id"),
        present("sender_domain").alias("sender_domain"),
        F.to_json(values).alias("features_json"),
        F.lit("{}").alias("metadata_json"),
    )


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Snappy Parquet by hour. The rebalance splits an hour too large for one task."""
    with_partitions(log).hint("rebalance", *LOG_PARTITIONS).write.mode(mode).option("compression", "snappy").partitionBy(
        *LOG_PARTITIONS
    ).parquet(path)


def _day_folders(spark: SparkSession, path: str, first: date, last: date) -> list[str]:
    """The day folders of the log from first to last that exist; one look-up a day, and no listing of the tree."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    days = (first + timedelta(days=i) for i in range((last - first).days + 1))
    folders = [f"{path.rstrip('/')}/{d:year=%Y/month=%m/day=%d}" for d in days]
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    return [f for f in folders if system.exists(jvm.org.apache.hadoop.fs.Path(f))]


def scan_log(spark: SparkSession, path: str, start: Column, end: Column, schema: T.StructType = INFERENCE_LOG) -> DataFrame:
    """Rows with start ≤ timestamp ≤ end; only the day folders of the range are listed and read."""
    full = T.StructType(schema.fields + [T.StructField(c, T.IntegerType()) for c in LOG_PARTITIONS])
    first, last = spark.range(1).select(F.to_date(start), F.to_date(end)).first()
    folders = _day_folders(spark, path, first, last) if first and last else []
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(full).option("basePath", path).parquet(*folders)
    return in_window(rows, start, end).drop(*LOG_PARTITIONS)


def in_window(log: DataFrame, start: Column, end: Column, ts: str = "timestamp") -> DataFrame:
    return log.where((F.col(ts) >= start) & (F.col(ts) <= end))


def flatten_features(log: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, feature, value) rows from ``features_json``.

    An unreadable JSON text yields no feature rows; :func:`bad_feature_rows` counts it.
    """
    return log.select(*keep, F.explode(parsed_features()).alias("feature", "value"))


def parsed_features(column: str = "features_json") -> Column:
    return F.from_json(column, "map<string,double>")


def bad_feature_rows(log: DataFrame) -> DataFrame:
    """Rows, and rows whose features cannot be read."""
    parsed = parsed_features()
    return log.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(parsed.isNull() | (F.size(parsed) == 0)).alias("bad_rows")
    )


def logged_features(log: DataFrame, features: Sequence[str]) -> list[str]:
    """Those of the features that at least one log row names, in the given order; one aggregate of one row."""
    parsed = log.select(parsed_features().alias("_f"))
    row = parsed.agg(*[F.max(F.map_contains_key("_f", F.lit(f))).alias(str(i)) for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if row[str(i)]]


def wide_features(log: DataFrame, features: Sequence[str]) -> DataFrame:
    """Named features as columns next to the prediction columns; every log row is kept."""
    fields = T.StructType([T.StructField(f, T.DoubleType()) for f in features])
    parsed = log.select("prediction", "spam_probability", F.from_json("features_json", fields).alias("_f"))
    return parsed.select(*[F.col("_f").getField(f).alias(f) for f in features], "prediction", "spam_probability")
