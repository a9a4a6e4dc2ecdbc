"""Thresholds and parameters. Every one is an argument of the operator that uses it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DriftConfig:
    window_hours: int = 24
    min_samples: int = 100
    psi: float = 0.2
    ks_pvalue: float = 0.05
    score_warning: float = 0.2
    score_critical: float = 0.5
    drifted_features: int = 3
    prediction_psi: float = 0.2
    prediction_psi_critical: float = 0.3
    missing_pct: float = 5.0
    out_of_range_pct: float = 1.0
    top_features: int = 50
    monitored_features: tuple[str, ...] = ()
    excluded_features: tuple[str, ...] = ()


@dataclass(frozen=True)
class GateConfig:
    min_f1: float = 0.85
    min_auc: float = 0.90
    min_precision: float = 0.80
    min_recall: float = 0.80
    max_latency_ms: float = 10.0
    max_ratio_difference: float = 0.5
    max_f1_regression: float = 0.05
    max_auc_regression: float = 0.05


@dataclass(frozen=True)
class SliceConfig:
    min_accuracy: float = 0.80
    max_false_positive_rate: float = 0.20
    min_ham_accuracy: float = 0.70


@dataclass(frozen=True)
class TfidfConfig:
    max_features: int = 500
    ngrams: tuple[int, int] = (1, 2)
    min_df: int = 5
    max_df: float = 0.95
    stop_words: tuple[str, ...] | None = field(default=None)  # None: Spark's English list
