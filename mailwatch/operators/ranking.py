"""Top-k, paging and payload truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_features(importances: DataFrame, n: int = 20) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows offset … offset+limit−1 in a stable order, and the one-row page information."""
    rows = df.orderBy(*order).offset(offset).limit(limit)
    total = F.count(F.lit(1))
    info = df.agg(
        total.alias("total_records"),
        F.least(F.greatest(total - offset, F.lit(0)), F.lit(limit)).cast("long").alias("returned_records"),
        (F.lit(offset + limit) < total).alias("has_more"),
    )
    return rows, info


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the highest F1 (smallest id wins ties)."""
    row = F.struct(*trials.columns)
    return trials.agg(F.max_by(row, F.struct("f1", -F.col("trial"))).alias("r")).select("r.*")


def leaderboard(trials: DataFrame) -> DataFrame:
    return trials.orderBy(F.col("f1").desc(), "trial")


def alert_payload(alerts: DataFrame, keys: Sequence[str], drifted: DataFrame, limit: int = 10) -> DataFrame:
    """Per report: overall severity, alert count, first alerts and first drifted names.

    Lists are bounded by the number of monitored features before they are cut.
    """
    head = F.slice(
        F.array_sort(F.collect_list(F.struct("rule_order", "severity", "message", "metric_name"))), 1, limit
    )
    critical = F.max((F.col("severity") == "critical").cast("int")) == 1
    per = alerts.groupBy(*keys).agg(
        F.when(critical, "critical").otherwise("warning").alias("severity"),
        F.count(F.lit(1)).alias("alerts_count"),
        head.alias("alerts"),
    )
    names = drifted.where("drift_detected").groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list("feature")), 1, limit).alias("drifted_features")
    )
    return per.join(names, list(keys), "left")
