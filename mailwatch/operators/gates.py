"""Pass/fail decisions over one-row metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GateConfig


def quality_gate(metrics: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """One row per checked metric: value, threshold, passed."""
    limits = {
        "f1": config.min_f1,
        "auc_roc": config.min_auc,
        "precision": config.min_precision,
        "recall": config.min_recall,
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).alias("value"),
                F.lit(float(limit)).alias("threshold"),
                F.coalesce(F.col(name) >= F.lit(float(limit)), F.lit(False)).alias("passed"),
            )
            for name, limit in limits.items()
        ]
    )
    return metrics.select(F.inline(rows))


def sanity_gate(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", config: GateConfig = GateConfig()
) -> DataFrame:
    """Predicted and actual spam share must be close, and both classes must be predicted."""
    row = scored.agg(
        F.avg(F.col(label).cast("double")).alias("actual_spam_ratio"),
        F.avg(F.col(prediction).cast("double")).alias("predicted_spam_ratio"),
        (F.max(F.col(prediction)) != F.min(F.col(prediction))).alias("diverse"),
    )
    gap = F.abs(F.col("predicted_spam_ratio") - F.col("actual_spam_ratio"))
    row = row.withColumn("ratio_difference", gap / F.greatest(F.col("actual_spam_ratio"), F.lit(0.01)))
    return row.withColumn("passed", (F.col("ratio_difference") < config.max_ratio_difference) & F.col("diverse"))


def latency_gate(performance: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    limit = F.lit(float(config.max_latency_ms))
    return performance.select(
        F.col("p95_latency_ms").alias("p95_ms"), limit.alias("threshold_ms"), (F.col("p95_latency_ms") <= limit).alias("passed")
    )


def compare_models(new: DataFrame, incumbent: DataFrame | None, config: GateConfig = GateConfig()) -> DataFrame:
    """Metric change of the new model; fails on a larger regression than allowed.

    Without an incumbent the comparison passes and the change is the model's own score.
    """
    cells: dict[str, Column] = {}
    for name in ("f1", "auc_roc"):
        base = F.lit(0.0) if incumbent is None else incumbent.select(name).scalar()
        cells[name] = F.col(name) - base
    out = new.select(cells["f1"].alias("f1_improvement"), cells["auc_roc"].alias("auc_improvement"))
    loss = lambda c: F.greatest(-F.col(c), F.lit(0.0))
    passed = (
        F.lit(True)
        if incumbent is None
        else (loss("f1_improvement") <= config.max_f1_regression)
        & (loss("auc_improvement") <= config.max_auc_regression)
    )
    return out.select(
        "*",
        loss("f1_improvement").alias("f1_regression"),
        loss("auc_improvement").alias("auc_regression"),
        passed.alias("passed"),
    )


def promotion_decision(validation: DataFrame, comparison: DataFrame) -> DataFrame:
    """Promoted when both inputs (one-row tables with ``passed``) pass; otherwise the reasons."""
    row = validation.agg(F.min("passed").alias("validation_passed")).withColumn(
        "comparison_passed", comparison.select("passed").scalar()
    )
    reasons = F.concat_ws(
        "; ",
        F.when(~F.col("validation_passed"), F.lit("validation failed")),
        F.when(~F.col("comparison_passed"), F.lit("comparison failed")),
    )
    return row.select(
        (F.col("validation_passed") & F.col("comparison_passed")).alias("promoted"),
        "validation_passed",
        "comparison_passed",
        reasons.alias("blocking_reasons"),
    )


def registry_row(metrics: DataFrame, model_name: str, version: str, min_f1: float, at: Column) -> DataFrame:
    """Registry entry with rounded tags; empty when F1 misses the threshold."""
    tags = {"test_f1": "f1", "test_auc_roc": "auc_roc", "test_precision": "precision", "test_recall": "recall"}
    return metrics.where(F.col("f1") >= min_f1).select(
        F.lit(model_name).alias("model_name"),
        F.lit(version).alias("model_version"),
        F.lit("Staging").alias("stage"),
        at.alias("registered_at"),
        *[F.round(F.col(c), 4).alias(t) for t, c in tags.items()],
    )

