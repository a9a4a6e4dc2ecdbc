"""Alert rules over drift reports, and the payloads built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DriftConfig

# --- fixed values: wording of the alerts ----------------------------------------------
SCORE_CRITICAL = "Critical drift detected: overall drift score %.2f%% exceeds threshold {}%%"
SCORE_WARNING = "Drift detected: overall drift score %.2f%% exceeds threshold {}%%"
PREDICTION = "Critical prediction drift: PSI %.3f exceeds threshold {}"
MANY_FEATURES = "Multiple features drifted: %d features show drift"
ONE_FEATURE = "Feature drift detected: %s has PSI %.3f"
MISSING = "Data quality issue: %.1f%% missing values"
OUT_OF_RANGE = "Data quality issue: %.1f%% out-of-range values"
ADVICE_CRITICAL = (
    "Immediate investigation required. Consider pausing model predictions and initiating retraining."
)
ADVICE_WARNING = "Monitor closely and consider scheduling model retraining."
ADVICE_PREDICTION = (
    "Model predictions may be unreliable. Review recent model outputs and consider retraining."
)
ADVICE_MANY = "Investigate data pipeline for changes. Drifted features: %s"
ADVICE_FEATURE = "Investigate changes in %s. Mean shifted from %.3f to %.3f"
ADVICE_MISSING = "Check data pipeline for issues. Missing data may impact prediction quality."
ADVICE_RANGE = "Investigate data source for anomalies or schema changes."
# --------------------------------------------------------------------------------------


def _alert(
    order: int, when: Column, severity: str, metric: str, value: Column, limit: float, message: Column,
    advice: Column, feature: Column | None = None,
) -> Column:
    row = F.struct(
        F.lit(order).alias("rule_order"),
        F.lit(severity).alias("severity"),
        (feature if feature is not None else F.lit(None).cast("string")).alias("feature"),
        message.alias("message"),
        advice.alias("recommendation"),
        F.lit(metric).alias("metric_name"),
        value.cast("double").alias("metric_value"),
        F.lit(float(limit)).alias("threshold"),
    )
    return F.when(when, row)


def _say(pattern: str, *args: Column, limit: str = "") -> Column:
    return F.format_string(pattern.replace("{}", limit), *args)


def report_alerts(reports: DataFrame, config: DriftConfig = DriftConfig(), key: str = "report_id") -> DataFrame:
    """Rules over the report row itself (score, predictions, feature count, data quality)."""
    score, psi = F.col("drift_score"), F.col("prediction_psi")
    n = F.col("features_drifted_count").cast("int")
    missing, outside, bad = F.col("missing_values_pct"), F.col("out_of_range_pct"), F.col("issues_detected")
    critical = score >= config.score_critical
    names = F.array_join(F.slice("features_drifted_names", 1, 5), ", ")
    rules = [
        _alert(1, critical, "critical", "drift_score", score, config.score_critical,
               _say(SCORE_CRITICAL, score * 100, limit=f"{config.score_critical:.0%}"[:-1]), F.lit(ADVICE_CRITICAL)),
        _alert(1, ~critical & (score >= config.score_warning), "warning", "drift_score", score, config.score_warning,
               _say(SCORE_WARNING, score * 100, limit=f"{config.score_warning:.0%}"[:-1]), F.lit(ADVICE_WARNING)),
        _alert(2, psi >= config.prediction_psi_critical, "critical", "prediction_psi", psi, config.prediction_psi_critical,
               _say(PREDICTION, psi, limit=f"{config.prediction_psi_critical}"), F.lit(ADVICE_PREDICTION),
               F.lit("prediction_probability")),
        _alert(3, n >= config.drifted_features, "warning", "features_drifted_count", n, config.drifted_features,
               _say(MANY_FEATURES, n), F.format_string(ADVICE_MANY, names)),
        _alert(5, bad & (missing > config.missing_pct), "warning", "missing_values_pct", missing, config.missing_pct,
               _say(MISSING, missing), F.lit(ADVICE_MISSING)),
        _alert(6, bad & (outside > config.out_of_range_pct), "warning", "out_of_range_pct", outside, config.out_of_range_pct,
               _say(OUT_OF_RANGE, outside), F.lit(ADVICE_RANGE)),
    ]
    return reports.select(key, F.inline(F.array_compact(F.array(*rules))))


def feature_alerts(drift: DataFrame, config: DriftConfig = DriftConfig(), key: str = "report_id") -> DataFrame:
    """One warning per drifted feature whose PSI reaches the threshold."""
    name, psi = F.col("feature"), F.col("psi")
    rule = _alert(
        4, F.col("drift_detected") & (psi >= config.psi), "warning", "feature_psi", psi, config.psi,
        F.format_string(ONE_FEATURE, name, psi),
        F.format_string(ADVICE_FEATURE, name, F.col("baseline_mean"), F.col("current_mean")),
        name,
    )
    return drift.select(key, F.inline(F.array_compact(F.array(rule))))


def generate_alerts(
    reports: DataFrame, drift: DataFrame, config: DriftConfig = DriftConfig(), key: str = "report_id"
) -> DataFrame:
    """All alerts of all reports; ``rule_order`` gives their order of severity rules."""
    return report_alerts(reports, config, key).unionByName(feature_alerts(drift, config, key))
