"""Labels, thresholds, confidence levels and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_column


def encode_label(c: Column | str, ignore_case: bool = False) -> Column:
    """ham → 0, spam → 1, anything else NULL."""
    c = as_column(c)
    c = F.lower(c) if ignore_case else c
    return F.when(c == "ham", F.lit(0)).when(c == "spam", F.lit(1))


def decide(probability: Column | str, threshold: float = 0.7) -> Column:
    """1 when the probability reaches the threshold (inclusive)."""
    return (as_column(probability) >= F.lit(float(threshold))).cast("int")


def label_name(label: Column | str) -> Column:
    return F.when(as_column(label) == 1, F.lit("spam")).otherwise(F.lit("ham"))


def confidence_online(p: Column | str) -> Column:
    p = as_column(p)
    return (
        F.when((p >= 0.9) | (p <= 0.1), "high").when((p >= 0.7) | (p <= 0.3), "medium").otherwise("low")
    )


def confidence_result(p: Column | str) -> Column:
    p = as_column(p)
    return F.when((p > 0.8) | (p < 0.2), "high").when((p > 0.6) | (p < 0.4), "medium").otherwise("low")


def psi_band(psi: Column | str) -> Column:
    psi = as_column(psi)
    return F.when(psi < 0.1, "none").when(psi <= 0.2, "minor").otherwise("significant")


def drift_status(score: Column | str, detected: Column | str) -> Column:
    score, detected = as_column(score), as_column(detected)
    return (
        F.when(score.isNull(), "unknown")
        .when(score >= 0.5, "critical")
        .when(detected, "warning")
        .otherwise("healthy")
    )
