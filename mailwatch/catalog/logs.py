"""Inference-log scans and analytics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.labels import confidence_online, confidence_result, decide, label_name
from ..functions.text import word_count
from ..operators.gates import latency_gate
from ..plans import log_analytics as L
from ..plans.scoring import decided
from ..sources.logs import bad_feature_rows, flatten_features, in_window, log_rows, parsed_features
from .aggregates import _rounded
from .features import SQL_TRAIN
from .views import JOB_TIME, LOGS_SQL, PREDICTIONS_SQL, logs, moment, predictions, with_views

START, END = "2024-01-10 22:00:00", "2024-01-11 06:00:00"
MONTH = ("2024-01-01 00:00:00", "2024-01-31 00:00:00")
_SECONDS = (datetime.fromisoformat(MONTH[1]) - datetime.fromisoformat(MONTH[0])).total_seconds()


def _performance(spark, sf):
    return L.performance(logs(spark, sf), moment(MONTH[0]), moment(MONTH[1]), _SECONDS)


_PERF_SQL = f"""perf AS (
  SELECT quantile_cont(latency_ms, 0.5) AS p50_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
    quantile_cont(latency_ms, 0.99) AS p99_latency_ms, avg(latency_ms) AS avg_latency_ms, count(*) / {_SECONDS}e0 AS requests_per_second,
    count(*) AS total_requests, CAST(count(*) FILTER (status = 'error') AS DOUBLE) / count(*) AS error_rate,
    CAST(count(*) FILTER (status = 'timeout') AS DOUBLE) / count(*) AS timeout_rate
  FROM logs WHERE timestamp BETWEEN TIMESTAMP '{MONTH[0]}' AND TIMESTAMP '{MONTH[1]}')"""


def _bad_rows(spark, sf):
    """Log rows of error events carry a broken JSON text."""
    broken = F.when(F.col("status") == "error", F.concat(F.lit("{"), "inference_id")).otherwise(F.col("features_json"))
    return bad_feature_rows(logs(spark, sf).withColumn("features_json", broken))


def _series(resolution: str, hours: int, end: str):
    unit = {"1m": "INTERVAL 1 MINUTE", "5m": "INTERVAL 5 MINUTE", "1h": "INTERVAL 1 HOUR"}[resolution]

    def run(spark, sf):
        return _rounded(L.latency_series(logs(spark, sf), moment(end), resolution, hours), keep=())

    sql = f"""SELECT time_bucket({unit}, timestamp) AS bucket, round(avg(latency_ms), 6) AS avg_latency_ms,
                max(latency_ms) AS max_latency_ms, count(*) AS n
              FROM logs WHERE timestamp >= TIMESTAMP '{end}' - INTERVAL {hours} HOUR AND timestamp <= TIMESTAMP '{end}' GROUP BY 1"""
    return run, with_views(LOGS_SQL, body=sql)


def _decisions(spark, sf):
    p = F.col("spam_probability")
    label = decide(p, 0.7)
    return logs(spark, sf).select("inference_id", label.alias("spam_label"), label_name(label).alias("prediction_label"))


def _log_rows(spark, sf):
    """Scored documents as log rows, their feature map read back."""
    rows = decided(predictions(spark, sf).drop("spam_label"), moment(JOB_TIME), "1").withColumn(
        "n_words", word_count("body_text")
    )
    log = log_rows(rows, ["n_words"], "spam-detector", "1", moment(JOB_TIME), F.col("email_id"), F.lit(2.5))
    return log.select(
        "inference_id", "timestamp", "model_version", "prediction", "latency_ms", "environment", "sender_domain",
        F.element_at(parsed_features(), "n_words").alias("n_words"),
    )


QUERIES = {
    "a07_log_window": (
        lambda spark, sf: in_window(logs(spark, sf), moment(START), moment(END)).select("inference_id", "timestamp", "prediction"),
        with_views(
            LOGS_SQL,
            body=f"SELECT inference_id, timestamp, prediction FROM logs WHERE timestamp >= TIMESTAMP '{START}' AND timestamp <= TIMESTAMP '{END}'",
        ),
    ),
    "f11_performance": (
        lambda spark, sf: _rounded(_performance(spark, sf), keep=()),
        with_views(
            LOGS_SQL, _PERF_SQL,
            body="""SELECT round(p50_latency_ms, 6) AS p50_latency_ms, round(p95_latency_ms, 6) AS p95_latency_ms, round(p99_latency_ms, 6) AS p99_latency_ms,
                      round(avg_latency_ms, 6) AS avg_latency_ms, round(requests_per_second, 6) AS requests_per_second, total_requests,
                      round(error_rate, 6) AS error_rate, round(timeout_rate, 6) AS timeout_rate FROM perf""",
        ),
    ),
    "f12_latency_series_1h": _series("1h", 24, "2024-01-20 12:00:00"),
    "f12_latency_series_5m": _series("5m", 168, "2024-01-20 12:00:00"),
    "f13_prediction_mix": (
        lambda spark, sf: L.prediction_mix(logs(spark, sf), moment(START), moment(END)),
        with_views(
            LOGS_SQL,
            body=f"""SELECT count(*) AS total_predictions, count(*) FILTER (prediction = 'spam') AS spam_count, count(*) FILTER (prediction = 'ham') AS ham_count,
                       round(CAST(count(*) FILTER (prediction = 'spam') AS DOUBLE) / count(*) * 100, 2) AS spam_percentage,
                       round(CAST(count(*) FILTER (prediction = 'ham') AS DOUBLE) / count(*) * 100, 2) AS ham_percentage
                     FROM logs WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'""",
        ),
    ),
    "f15_request_batches": (
        lambda spark, sf: L.request_batches(logs(spark, sf), "user_id"),
        with_views(
            LOGS_SQL,
            body="""SELECT user_id, count(*) AS total_count, count(*) FILTER (status <> 'error') AS success_count,
                      count(*) FILTER (status = 'error') AS error_count, round(sum(latency_ms), 2) AS total_latency_ms,
                      round(sum(latency_ms) / count(*), 2) AS avg_latency_ms FROM logs GROUP BY user_id""",
        ),
    ),
    "g13_flattened_features": (
        lambda spark, sf: flatten_features(logs(spark, sf), ["inference_id"]),
        with_views(
            LOGS_SQL,
            body="""SELECT inference_id, 'value' AS feature, value FROM logs
                    UNION ALL SELECT inference_id, 'k', CAST(k AS DOUBLE) FROM logs""",
        ),
    ),
    "g13_bad_feature_rows": (
        _bad_rows,
        with_views(LOGS_SQL, body="SELECT count(*) AS rows, count(*) FILTER (status = 'error') AS bad_rows FROM logs"),
    ),
    "h19_latency_gate": (
        lambda spark, sf: _rounded(latency_gate(_performance(spark, sf)), keep=()),
        with_views(
            LOGS_SQL, _PERF_SQL,
            body="SELECT round(p95_latency_ms, 6) AS p95_ms, 10.0e0 AS threshold_ms, p95_latency_ms <= 10 AS passed FROM perf",
        ),
    ),
    "i02_decisions": (
        _decisions,
        with_views(
            LOGS_SQL,
            body="""SELECT inference_id, CAST(k >= 70 AS INTEGER) AS spam_label,
                      CASE WHEN k >= 70 THEN 'spam' ELSE 'ham' END AS prediction_label FROM logs""",
        ),
    ),
    "i07_log_rows": (
        _log_rows,
        with_views(
            PREDICTIONS_SQL,
            body=f"""SELECT email_id AS inference_id, TIMESTAMP '{JOB_TIME}' AS timestamp, '1' AS model_version,
                       CASE WHEN spam_label = 1 THEN 'spam' ELSE 'ham' END AS prediction, 2.5e0 AS latency_ms, 'production' AS environment,
                       '' AS sender_domain, CAST({SQL_TRAIN["word_count"]} AS DOUBLE) AS n_words FROM predictions""",
        ),
    ),
    "i04_confidence_online": (
        lambda spark, sf: logs(spark, sf).select("inference_id", confidence_online("spam_probability").alias("confidence")),
        with_views(
            LOGS_SQL,
            body="""SELECT inference_id, CASE WHEN k >= 90 OR k <= 10 THEN 'high' WHEN k >= 70 OR k <= 30 THEN 'medium' ELSE 'low' END AS confidence FROM logs""",
        ),
    ),
    "i05_confidence_result": (
        lambda spark, sf: logs(spark, sf).select("inference_id", confidence_result("spam_probability").alias("confidence")),
        with_views(
            LOGS_SQL,
            body="""SELECT inference_id, CASE WHEN k > 80 OR k < 20 THEN 'high' WHEN k > 60 OR k < 40 THEN 'medium' ELSE 'low' END AS confidence FROM logs""",
        ),
    ),
}
