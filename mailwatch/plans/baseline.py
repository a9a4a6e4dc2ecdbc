"""Baseline profile of a training table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import target_distribution
from ..operators.distribution import feature_statistics, histogram, to_long

PREDICTION_FEATURE = "spam_probability"


@dataclass(frozen=True)
class Baseline:
    """Statistics and histograms in long form, one row per feature / per bin."""

    stats: DataFrame
    histogram: DataFrame
    target: DataFrame | None = None
    metadata: DataFrame | None = None

    def for_features(self, names: Sequence[str]) -> "Baseline":
        keep = F.col("feature").isin(list(names))
        return Baseline(self.stats.where(keep), self.histogram.where(keep), self.target, self.metadata)


def generate_baseline(
    train: DataFrame,
    features: Sequence[str],
    model_name: str,
    model_version: str,
    created_at: Column,
    path: str = "",
    label: str | None = "label",
    probability: str | None = None,
    bins: int = 20,
    approximate: bool = False,
) -> Baseline:
    """Profile the features that exist in the table; the probability column is one more feature."""
    present = [f for f in features if f in train.columns]
    profiled = present + ([probability] if probability else [])
    long = to_long(train, profiled)
    metadata = train.agg(F.count(F.lit(1)).alias("num_samples")).select(
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        created_at.alias("created_at"),
        F.lit(path).alias("training_data_path"),
        "num_samples",
        F.lit(len(present)).alias("feature_count"),
    )
    return Baseline(
        feature_statistics(long, approximate),
        histogram(long, bins),
        target_distribution(train, label) if label else None,
        metadata,
    )


def baseline_table(baseline: Baseline, model_name: str, model_version: str, created_at: Column) -> DataFrame:
    """One row per feature with its bins nested, ready for ``sources.tables.save_baseline``."""
    bins = baseline.histogram.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("bin", "bin_start", "bin_end", "count", "density"))).alias("bins")
    )
    return baseline.stats.join(bins, "feature", "left").select(
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        created_at.alias("created_at"),
        *baseline.stats.columns,
        "bins",
    )


def baseline_from_table(table: DataFrame) -> Baseline:
    stats = table.drop("model_name", "model_version", "created_at", "bins")
    return Baseline(stats, table.select("feature", F.inline("bins")))
