"""Profiles of numeric columns in long form: (feature, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null, ratio
from . import sketches
from .ordered import ecdf, exact_quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One (feature, value) row per cell; NaN becomes NULL. Map-side only."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), nan_to_null(f).alias("value")) for f in features])
    return df.select(*keep, F.inline(cells))


def moments(long: DataFrame, *more: Column) -> DataFrame:
    """Per feature: counts, mean, population std and range, and further aggregates. Combines map-side."""
    missing = F.count_if(F.col("value").isNull())
    n = F.count(F.lit(1))
    return long.groupBy("feature").agg(
        n.alias("total"),
        missing.alias("missing_count"),
        ratio(missing, n).alias("missing_ratio"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *more,
    )


def feature_statistics(long: DataFrame, approximate: bool = False, size: int = sketches.SIZE) -> DataFrame:
    """Mean, std, range, quartiles, missing and distinct counts per feature.

    Exact by default. ``approximate`` makes sketches in the aggregate of the moments, one pass without a shuffle of values, and
    keeps them in a column ``sketch`` (null for a feature without values), to be stored and merged. Features without any value
    report zeros and a missing ratio of 1.
    """
    if approximate:
        found = moments(long, sketches.sketch_of("value", size).alias("_sketch"), F.approx_count_distinct("value").alias("unique_count"))
        sketch = F.when(F.col("missing_count") < F.col("total"), F.col("_sketch"))
        joined = found.withColumns({"sketch": sketch, **{n: sketches.quantile(sketch, q) for n, q in QUARTILES.items()}})
    else:
        joined = moments(long).join(F.broadcast(exact_quantiles(long, QUARTILES)), "feature", "left")  # one row per feature
    zeros = ["mean", "std", "min", "max", *QUARTILES]
    return joined.select(
        "feature",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in zeros],
        "missing_count",
        "missing_ratio",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        *(["sketch"] if approximate else []),
    )


def bin_of(value: Column, low: Column, high: Column, bins: int | Column) -> Column:
    """Index of the equal-width bin; the last bin is closed on the right."""
    bins = F.lit(bins) if isinstance(bins, int) else bins
    width = F.when(high > low, high - low)
    raw = F.floor((value - low) * bins.cast("double") / width)
    return F.least(raw, bins.cast("long") - 1).cast("int")


def bounds(long: DataFrame) -> DataFrame:
    """Value range per feature; constant features get a range of ±0.5 around the constant."""
    flat = F.col("lo") == F.col("hi")
    return (
        long.groupBy("feature")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .where(F.col("lo").isNotNull())
        .select(
            "feature",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    )


def bin_grid(ranges: DataFrame, bins: int) -> DataFrame:
    """All bins of every feature with their edges (features × bins rows)."""
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.select(
        "feature",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
    )


def histogram(long: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of every feature: edges, count and share, empty bins included."""
    ranges = bounds(long)
    counts = (
        long.where(F.col("value").isNotNull())
        .join(F.broadcast(ranges), "feature")  # one row per feature
        .groupBy("feature", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    full = bin_grid(ranges, bins).join(counts, ["feature", "bin"], "left").join(totals, "feature")
    count = F.coalesce("n", F.lit(0))
    return full.select(
        "feature", "bin", "bin_start", "bin_end", count.alias("count"), ratio(count, F.col("total")).alias("density")
    )


def prediction_distribution(df: DataFrame, probability: str = "spam_probability") -> DataFrame:
    """Mean, std and median of a probability column; 0.5 / 0 / 0.5 when it is empty."""
    long = to_long(df, [probability])
    shape = exact_quantiles(long, {"median": 0.5})
    joined = moments(long).join(F.broadcast(shape), "feature", "left")
    empty = {"mean": 0.5, "std": 0.0, "median": 0.5}
    cells = [F.coalesce(F.max(c), F.lit(v)).alias(f"{c}_probability") for c, v in empty.items()]
    return joined.agg(*cells)


def distribution_table(long: DataFrame) -> DataFrame:
    """Distinct values with counts and the empirical CDF, per feature."""
    return ecdf(long)
