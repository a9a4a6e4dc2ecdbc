"""Drift detection of a log window against a baseline, and the report rows it yields."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DriftConfig
from ..functions.labels import drift_status
from ..operators import drift as D
from ..operators.distribution import to_long
from ..sources.logs import in_window, logged_features, wide_features
from .alerting import generate_alerts
from .baseline import PREDICTION_FEATURE, Baseline


@dataclass(frozen=True)
class Detection:
    report: DataFrame
    feature_drift: DataFrame
    prediction_drift: DataFrame
    data_quality: DataFrame
    alerts: DataFrame
    current: DataFrame

    def close(self) -> None:
        """Releases the cached window."""
        self.current.unpersist()


def pinned(*small: DataFrame) -> list[DataFrame]:
    """Results of one row per feature (or bin), computed side by side and kept as local tables."""
    with ThreadPoolExecutor(len(small)) as pool:
        rows = list(pool.map(lambda df: df.collect(), small))
    return [df.sparkSession.createDataFrame(r, df.schema) for df, r in zip(small, rows)]


def overall_drift(score: Column, drifted: Column, prediction: Column, config: DriftConfig = DriftConfig()) -> Column:
    return (
        (score >= config.score_warning)
        | (drifted >= config.drifted_features)
        | F.coalesce(prediction, F.lit(False))
    )


def run_detection(
    baseline: Baseline,
    logs: DataFrame,
    features: Sequence[str],
    start: Column,
    end: Column,
    report_id: str,
    model_name: str,
    model_version: str,
    config: DriftConfig = DriftConfig(),
    baseline_rows: DataFrame | None = None,
    cache: bool = True,
) -> Detection:
    """Window → long features → drift, quality, score, decision, alerts.

    The flattened window is cached (spilling to disk) because several branches read it. The
    branch results hold at most one row per monitored feature or bin; they are computed
    once, and report and alerts are derived from them without touching the log again.
    """
    names = D.monitored_features(features, config)
    window = in_window(logs, start, end)
    # A feature that no row of the window names is absent, and left out of all but the count of absent
    # ones. Of the others every log row is kept: a missing or unreadable value is NULL.
    present = logged_features(window, names)
    current = to_long(wide_features(window, present), [*present, PREDICTION_FEATURE])
    if cache:
        current = current.persist(StorageLevel.MEMORY_AND_DISK)
    is_prediction = F.col("feature") == PREDICTION_FEATURE
    wanted = baseline.for_features([*names, PREDICTION_FEATURE])
    stored = Baseline(*pinned(wanted.stats, wanted.histogram))
    known = stored.for_features(names)

    # The probability is measured like one more feature, in the same job.
    measured, quality, samples = pinned(
        D.feature_drift(stored.stats, stored.histogram, current, config, baseline_rows),
        D.dataset_quality(current.where(~is_prediction), known.stats, names, config),
        current.where(is_prediction).agg(F.count(F.lit(1)).alias("n")),
    )
    drift = measured.where(~is_prediction)
    prediction = measured.where(is_prediction).select(
        "psi", "mean_shift", "baseline_mean", "current_mean", (F.col("psi") > config.prediction_psi).alias("drift_detected")
    )
    drift_named = drift.select(F.lit(report_id).alias("report_id"), "*")

    row = D.drift_score(drift, prediction).withColumns(
        {
            "quality": quality.select(F.struct("*")).scalar(),
            "prediction_psi": prediction.select("psi").scalar(),
            "prediction_drifted": prediction.select("drift_detected").scalar(),
            "features_drifted_names": drift.where("drift_detected")
            .agg(F.array_sort(F.collect_list("feature")))  # bounded by the monitored features
            .scalar(),
            "num_samples": samples.scalar(),
        }
    ).withColumn("features_drifted_count", F.size("features_drifted_names").cast("long"))
    report = row.select(
        F.lit(report_id).alias("report_id"),
        end.alias("generated_at"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        start.alias("window_start"),
        end.alias("window_end"),
        "num_samples",
        (F.col("num_samples") < config.min_samples).alias("insufficient_samples"),
        overall_drift(F.col("drift_score"), F.col("features_drifted_count"), F.col("prediction_drifted"), config).alias(
            "overall_drift_detected"
        ),
        "drift_score",
        F.lit(len(names)).cast("long").alias("total_features"),
        "features_drifted_count",
        "features_drifted_names",
        "prediction_psi",
        "quality.*",
    )
    return Detection(report, drift_named, prediction, quality, generate_alerts(report, drift_named, config), current)


def latest_report(reports: DataFrame) -> DataFrame:
    """Newest report of every model."""
    row = F.struct(*[c for c in reports.columns if c != "model_name"])
    return reports.groupBy("model_name").agg(F.max_by(row, F.struct("generated_at", "report_id")).alias("r")).select(
        "model_name", "r.*"
    )


def status_of(models: DataFrame, reports: DataFrame) -> DataFrame:
    """Status per requested model: critical, warning, healthy, or unknown without a report."""
    joined = models.join(latest_report(reports), "model_name", "left")
    return joined.select(
        "model_name",
        drift_status("drift_score", "overall_drift_detected").alias("status"),
        F.coalesce("overall_drift_detected", F.lit(False)).alias("drift_detected"),
        F.coalesce("drift_score", F.lit(0.0)).alias("drift_score"),
        F.col("generated_at").alias("last_checked"),
    )


def report_summary(reports: DataFrame, alerts: DataFrame) -> DataFrame:
    """Summary row of the newest report per model, with the job's exit class."""
    per = alerts.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("alerts_count"),
        F.max((F.col("severity") == "critical").cast("int")).alias("any_critical"),
    )
    joined = latest_report(reports).join(per, "report_id", "left")
    critical = F.coalesce("any_critical", F.lit(0)) == 1
    return joined.select(
        "model_name",
        "model_version",
        F.col("generated_at").alias("last_checked"),
        F.col("overall_drift_detected").alias("drift_detected"),
        "drift_score",
        F.array_join(F.slice("features_drifted_names", 1, 10), ",").alias("features_drifted"),
        F.coalesce("alerts_count", F.lit(0)).alias("alerts_count"),
        F.col("num_samples").alias("samples_analyzed"),
        F.when(critical, 2).when(F.col("overall_drift_detected"), 1).otherwise(0).alias("exit_class"),
    )


def history_summary(reports: DataFrame, newest: int = 100) -> DataFrame:
    """Average and maximum score over the newest reports of the history."""
    kept = reports.orderBy(F.col("generated_at").desc(), F.col("report_id").desc()).limit(newest)
    zero = F.lit(0.0)
    return kept.agg(
        F.coalesce(F.avg("drift_score"), zero).alias("avg_drift_score"),
        F.coalesce(F.max("drift_score"), zero).alias("max_drift_score"),
        F.count_if("overall_drift_detected").alias("drift_detected_count"),
        F.count(F.lit(1)).alias("total_reports"),
    )


def feature_history(reports: DataFrame, drift: DataFrame, feature: str | None = None, newest: int = 20) -> DataFrame:
    """psi and flag of each feature over the newest reports."""
    kept = reports.orderBy(F.col("generated_at").desc(), F.col("report_id").desc()).limit(newest)
    rows = drift if feature is None else drift.where(F.col("feature") == feature)
    return rows.join(F.broadcast(kept.select("report_id", "generated_at")), "report_id").select(  # ≤ newest rows
        "feature", F.col("generated_at").alias("timestamp"), "psi", "drift_detected"
    )


def monitoring_summary(reports: DataFrame) -> DataFrame:
    """Scores per report row; NULLs (no data) give 0, 0 and 1."""
    quality = F.lit(1.0) - (F.col("missing_values_pct") + F.col("out_of_range_pct")) / 100
    prediction = F.lit(1.0) - F.exp(-F.col("prediction_psi"))
    return reports.select(
        "report_id",
        F.coalesce("drift_score", F.lit(0.0)).alias("feature_drift_score"),
        F.coalesce(prediction, F.lit(0.0)).alias("prediction_drift_score"),
        F.coalesce(F.greatest(F.least(quality, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("data_quality_score"),
        F.coalesce("overall_drift_detected", F.lit(False)).alias("drift_detected"),
        F.array_join("features_drifted_names", ",").alias("drifted_features"),
        "window_start",
        "window_end",
    )
