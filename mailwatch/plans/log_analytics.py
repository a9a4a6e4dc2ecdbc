"""Latency, throughput and prediction mix of the inference log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.distribution import to_long
from ..operators.ordered import exact_quantiles
from ..sources.logs import in_window

RESOLUTIONS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour"}
LATENCY_QUANTILES = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}


def performance(log: DataFrame, start: Column, end: Column, window_seconds: float) -> DataFrame:
    """Latency quantiles, throughput and error shares of a window; zeros when it is empty."""
    rows = in_window(log, start, end)
    quantiles = exact_quantiles(to_long(rows, ["latency_ms"]), LATENCY_QUANTILES)
    n = F.count(F.lit(1))
    share = lambda status: (
        ratio(F.count_if(F.col("status") == status), n) if "status" in log.columns else F.lit(0.0)
    )
    row = rows.agg(
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        (n / F.lit(float(window_seconds))).alias("requests_per_second"),
        n.alias("total_requests"),
        share("error").alias("error_rate"),
        share("timeout").alias("timeout_rate"),
    )
    return row.withColumns(
        {q: F.coalesce(quantiles.agg(F.max(q)).scalar(), F.lit(0.0)) for q in LATENCY_QUANTILES}
    )


def latency_series(log: DataFrame, end: Column, resolution: str = "1h", hours: int = 24) -> DataFrame:
    """Mean, maximum and count of latency per time bucket of the last ``hours``, newest first."""
    cutoff = end - F.make_dt_interval(hours=F.lit(hours))
    return (
        in_window(log, cutoff, end)
        .groupBy(F.window("timestamp", RESOLUTIONS[resolution]).alias("w"))
        .agg(F.avg("latency_ms").alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("bucket"), "avg_latency_ms", "max_latency_ms", "n")
        .orderBy(F.col("bucket").desc())
    )


def prediction_mix(log: DataFrame, start: Column, end: Column) -> DataFrame:
    n = F.count(F.lit(1))
    spam = F.count_if(F.col("prediction") == "spam")
    ham = F.count_if(F.col("prediction") == "ham")
    return in_window(log, start, end).agg(
        n.alias("total_predictions"),
        spam.alias("spam_count"),
        ham.alias("ham_count"),
        F.round(ratio(spam, n) * 100, 2).alias("spam_percentage"),
        F.round(ratio(ham, n) * 100, 2).alias("ham_percentage"),
    )


def request_batches(log: DataFrame, batch: str) -> DataFrame:
    """Success, error and latency totals per request batch."""
    n = F.count(F.lit(1))
    failed = F.count_if(F.col("status") == "error")
    total = F.sum("latency_ms")
    return log.groupBy(batch).agg(
        n.alias("total_count"),
        (n - failed).alias("success_count"),
        failed.alias("error_count"),
        F.round(total, 2).alias("total_latency_ms"),
        F.round(ratio(total, n), 2).alias("avg_latency_ms"),
    )
