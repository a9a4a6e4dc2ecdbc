"""Ordered computations that never put one group into one task.

A plain ``Window.partitionBy(feature).orderBy(value)`` sends a whole feature to a single
task. Here every group is cut into value ranges of about equal mass; ranges are ordered
independently and joined with the (small) running totals of the ranges before them. The
cut points only balance the work: any cut points give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Sampled values for each range: more make the ranges more even.
_EACH = 16


def _cut_points(df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], ranges: int) -> DataFrame:
    """(keys, _cuts): about ``ranges`` sorted cut points per group, as part of the plan.

    ``df`` has one row per (keys, order). A hash of the value decides which rows are looked at, so every branch and every
    repeated task finds the same cut points, whatever the order of the rows. Groups are feature names.
    """
    # Groups and values without any mass need no place. (As all branches read the same columns, they share one shuffle of ``df``.)
    some = lambda names: reduce(or_, [F.coalesce(F.col(m) > 0, F.lit(False)) for m in names])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(m).alias(f"_all_{m}") for m in measures])
    sizes = sizes.where(some([f"_all_{m}" for m in measures])).select(*keys, "_rows")
    share = F.coalesce(F.lit(float(_EACH * ranges)) / F.col("_rows"), F.lit(0.0))
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(order).cast("double")), 11) * F.lit(2.0**-53)
    looked_at = df.join(F.broadcast(sizes), list(keys), "left").where((drawn < share) & some(measures))
    found = looked_at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(order).cast("double"))).alias("_seen"))
    places = F.sequence(F.lit(_EACH - 1), F.greatest(F.size("_seen") - 1, F.lit(_EACH - 1)), F.lit(_EACH))
    cuts = F.filter(F.transform(places, lambda i: F.get("_seen", i)), lambda c: c.isNotNull())
    return found.select(*keys, cuts.alias("_cuts"))


def _range_of(value: Column, cuts: Column, ranges: int) -> Column:
    """Number of cut points below the value, found in two short scans."""
    step = max(int(ranges**0.5), 1)
    coarse = F.filter(cuts, lambda _, i: i % step == 0)
    block = F.size(F.filter(coarse, lambda c: c < value)) - 1
    start = F.greatest(block, F.lit(0)) * step
    inside = F.size(F.filter(F.slice(cuts, start + 1, F.lit(step)), lambda c: c < value))
    return F.when(block < 0, F.lit(0)).otherwise(start + inside)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    ranges: int | None = None,
) -> DataFrame:
    """Per group and in ascending ``order``: totals before each row, and the next order value.

    ``df`` holds one row per (keys, order). Adds ``before_<measure>`` and ``total_<measure>``
    (of the whole group) for every measure, and ``next_<order>`` (NULL on the last row). Nothing runs before the plan does, and
    what ``df`` is made from is read once: cut points and both uses of the rows share its shuffle.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    if ranges > 1:
        cuts = _cut_points(df, keys, order, measures, ranges)
        # Bounded: one array of < ranges doubles per feature.
        ranged = df.join(F.broadcast(cuts), keys, "left")
        ranged = ranged.withColumn(
            "_range",
            F.coalesce(_range_of(F.col(order).cast("double"), F.col("_cuts"), ranges), F.lit(0)),
        ).drop("_cuts")
    else:
        ranged = df.withColumn("_range", F.lit(0))

    per_range = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(m).alias(f"_sum_{m}") for m in measures], F.min(order).alias("_first")
    )
    # One row per (feature, range): at most `ranges` rows in any window partition.
    earlier = Window.partitionBy(*keys).orderBy("_range")
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    offsets = per_range.select(
        *keys,
        "_range",
        *[
            F.coalesce(
                F.sum(f"_sum_{m}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), zero
            ).alias(f"_off_{m}")
            for m in measures
        ],
        *[F.sum(f"_sum_{m}").over(whole).alias(f"total_{m}") for m in measures],
        F.lead("_first").over(earlier).alias("_next_first"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    local = ranged.select(
        "*",
        *[
            F.coalesce(F.sum(m).over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero).alias(f"_in_{m}")
            for m in measures
        ],
        F.lead(order).over(inside).alias("_next_in"),
    )
    joined = local.join(F.broadcast(offsets), [*keys, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_off_{m}") + F.col(f"_in_{m}")).alias(f"before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
        F.coalesce("_next_in", "_next_first").alias(f"next_{order}"),
    )


def value_counts(long: DataFrame, keys: Sequence[str], value: str, sides: dict[str, Column] | None = None) -> DataFrame:
    """Rows per (keys, value), NULL values left out; ``sides`` adds conditional counts."""
    counts = [F.count(F.when(cond, True)).alias(name) for name, cond in (sides or {}).items()]
    return (
        long.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*(counts or [F.count(F.lit(1)).alias("n")]))
    )


def ecdf(long: DataFrame, keys: Sequence[str] = ("feature",), value: str = "value", ranges: int | None = None) -> DataFrame:
    """Empirical distribution: per distinct value its count, count before it, and F(value)."""
    counts = value_counts(long, keys, value)
    run = running_totals(counts, keys, value, ["n"], ranges).withColumnRenamed("total_n", "total")
    return run.withColumn("cdf", (F.col("before_n") + F.col("n")).cast("double") / F.col("total"))


def exact_quantiles(
    long: DataFrame,
    quantiles: dict[str, float],
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    ranges: int | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, plus ``unique_count``.

    Equal to the usual sort-and-interpolate definition without collecting a group.
    """
    steps = table if table is not None else ecdf(long, keys, value, ranges)
    v, nxt = F.col(value), F.col(f"next_{value}")
    columns = []
    for name, q in quantiles.items():
        rank = (F.col("total") - 1).cast("double") * F.lit(float(q))
        low = F.floor(rank)
        holds = (F.col("before_n") <= low) & (low < F.col("before_n") + F.col("n"))
        upper = F.when(low + 1 < F.col("before_n") + F.col("n"), v).otherwise(F.coalesce(nxt, v))
        columns.append(F.max(F.when(holds, v + (upper - v) * (rank - low))).alias(name))
    return steps.groupBy(*keys).agg(*columns, F.count(F.lit(1)).alias("unique_count"))


def average_ranks(long: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Tie-aware 1-based rank of every distinct value."""
    return ecdf(long, keys, value, ranges).select(
        *keys,
        value,
        F.col("n").alias("ties"),
        (F.col("before_n").cast("double") + (F.col("n") + 1).cast("double") / 2).alias("avg_rank"),
    )
