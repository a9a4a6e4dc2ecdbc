"""Exact stratified split without ranking a whole class in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: str, seed: int) -> Column:
    """Pseudo-random but reproducible order of the rows."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def split_cutoffs(df: DataFrame, label: str, key: str, test_ratio: float, seed: int) -> DataFrame:
    """Per class: the order key of its round(n·ratio)-th row.

    The first four hex digits of the key give 65,536 buckets. Bucket counts locate the
    bucket holding the cutoff; only that bucket's rows are ranked.
    """
    keyed = df.select(label, order_key(key, seed).alias("_o")).withColumn("_b", F.left("_o", F.lit(4)))
    counts = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = Window.partitionBy(label).orderBy("_b")
    whole = Window.partitionBy(label)
    located = counts.select(
        label,
        "_b",
        "n",
        (F.sum("n").over(by_bucket) - F.col("n")).alias("before"),
        F.round(F.sum("n").over(whole) * F.lit(float(test_ratio))).cast("long").alias("take"),
    ).where((F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("n")))
    # One row per class.
    candidates = keyed.join(F.broadcast(located), [label, "_b"])
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_o"))
    return (
        candidates.withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("take") - F.col("before"))
        .select(label, F.col("_o").alias("_cutoff"))
    )


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "email_id", test_ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: exactly round(n·ratio) rows of every class, keys being unique."""
    cutoffs = split_cutoffs(df, label, key, test_ratio, seed)
    joined = df.join(F.broadcast(cutoffs), label, "left")  # one row per class
    return joined.withColumn(
        "is_test", F.coalesce(order_key(key, seed) <= F.col("_cutoff"), F.lit(False))
    ).select(*df.columns, "is_test")


def train_test(df: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    marked = stratified_split(df, **kwargs)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
