"""Event-time windows over the log. The same functions serve streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.distribution import bin_of
from ..operators.drift import baseline_bins, psi_proportions
from ..functions.divergence import clipped, psi_term
from ..functions.numeric import ratio

LATE = "1 hour"


def _watermarked(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("timestamp", delay) if df.isStreaming else df


def prediction_counters(log: DataFrame, every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Predictions and latency per tumbling window and class."""
    return (
        _watermarked(log, late)
        .groupBy(F.window("timestamp", every).alias("w"), "prediction")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "prediction", "n", "avg_latency_ms", "max_latency_ms")
    )


def binned(long: DataFrame, histogram: DataFrame) -> DataFrame:
    """(timestamp, feature, value) rows placed in the baseline's bins, outsiders dropped."""
    v = F.col("value")
    edges = F.broadcast(baseline_bins(histogram))  # one row per feature
    return (
        long.join(edges, "feature")
        .where((v >= F.col("lo")) & (v <= F.col("hi")))
        .select("timestamp", "feature", bin_of(v, F.col("lo"), F.col("hi"), F.col("bins")).alias("bin"))
    )


def sliding_bin_counts(
    long: DataFrame, histogram: DataFrame, size: str = "24 hours", every: str = "1 hour", late: str = LATE
) -> DataFrame:
    """Streaming form: rows per (window, feature, bin). State holds counts, never values."""
    return (
        binned(_watermarked(long, late), histogram)
        .groupBy(F.window("timestamp", size, every).alias("w"), "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n_cur"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "bin", "n_cur")
    )


def hourly_bin_counts(long: DataFrame, histogram: DataFrame) -> DataFrame:
    return (
        binned(long, histogram)
        .groupBy(F.window("timestamp", "1 hour").alias("w"), "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n_cur"))
        .select(F.col("w.start").alias("hour"), "feature", "bin", "n_cur")
    )


def sliding_from_hourly(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Batch form: the raw rows are counted once per hour, only hour counts are fanned out."""
    starts = F.sequence(F.lit(0), F.lit(hours - 1))
    fanned = hourly.select("*", F.explode(starts).alias("_back"))
    start = F.col("hour") - F.make_dt_interval(hours=F.col("_back"))
    return (
        fanned.groupBy(start.alias("window_start"), "feature", "bin")
        .agg(F.sum("n_cur").alias("n_cur"))
        .select("window_start", (F.col("window_start") + F.make_dt_interval(hours=F.lit(hours))).alias("window_end"), "feature", "bin", "n_cur")
    )


def window_psi(counts: DataFrame, histogram: DataFrame) -> DataFrame:
    """PSI per window and feature from bin counts; bins without rows count as 0."""
    key = ["window_start", "window_end", "feature"]
    totals = counts.groupBy(*key).agg(F.sum("n_cur").alias("total"))
    base = histogram.select("feature", "bin", F.col("density").alias("p_base"))
    grid = totals.join(base, "feature").join(counts, [*key, "bin"], "left")
    p_cur = ratio(F.coalesce("n_cur", F.lit(0)), F.col("total"))
    return psi_proportions(grid.select(*key, "bin", "p_base", p_cur.alias("p_cur")), keys=key)


def sliding_psi(long: DataFrame, histogram: DataFrame, hours: int = 24, late: str = LATE, limit: float = 0.2) -> DataFrame:
    """PSI and drift flag per sliding window and feature, for streams (append mode) and tables alike.

    Rows are counted once per hour; only hour counts enter the sliding windows, and only windows
    the PSI. The state has a row per hour or window, feature and bin.
    """
    hour = F.window("timestamp", "1 hour").alias("hour")
    counts = binned(_watermarked(long, late), histogram).groupBy(hour, "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    span = F.window(F.window_time("hour"), f"{hours} hours", "1 hour").alias("w")
    spans = counts.groupBy(span, "feature", "bin").agg(F.sum("n").alias("n"))
    cells = spans.groupBy("w", "feature").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("cells")  # one entry per bin
    )
    # One row per feature.
    base = histogram.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "density"))).alias("base"))
    shares = cells.join(F.broadcast(base), "feature").select(
        "w", "feature", F.transform("base", lambda b: clipped(b["density"])).alias("p"),
        F.transform("base", lambda b: clipped(F.coalesce(F.element_at("cells", b["bin"]), F.lit(0)) / F.col("total"))).alias("q"),
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    terms = F.zip_with("p", "q", lambda b, c: psi_term(b / F.col("sp"), c / F.col("sq")))
    return shares.withColumns({"sp": total("p"), "sq": total("q")}).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", total(terms).alias("psi")
    ).withColumn("drift_detected", F.col("psi") > limit)


def retained(series: DataFrame, now: Column, hours: int = 24, ts: str = "window_start") -> DataFrame:
    """Series points of the last ``hours``."""
    return series.where(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours)))
