"""Grouped counts, label mixes, null profiles and summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SliceConfig
from ..functions.numeric import nan_to_null, ratio
from ..sources.tables import numeric_columns


def sender_features(emails: DataFrame, event_timestamp: Column | None = None) -> DataFrame:
    """Mail counts by sender domain; NULL domains dropped, the empty domain is a group."""
    n = F.count(F.lit(1))
    spam = F.count_if(F.col("label") == "spam")
    out = (
        emails.where(F.col("sender_domain").isNotNull())
        .groupBy("sender_domain")
        .agg(
            n.alias("email_count"),
            spam.alias("spam_count"),
            F.count_if(F.col("label") == "ham").alias("ham_count"),
            ratio(spam, n).alias("spam_ratio"),
        )
    )
    return out if event_timestamp is None else out.withColumn("event_timestamp", event_timestamp)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per label."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("share", ratio(F.col("n"), total))


def target_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Shares of spam and ham over all rows; labels may be 0/1 or text."""
    text = dict(df.dtypes)[label] == "string"
    spam, ham = ("spam", "ham") if text else (1, 0)
    n = F.count(F.lit(1))
    return df.agg(
        ratio(F.count_if(F.col(label) == spam), n).alias("spam"),
        ratio(F.count_if(F.col(label) == ham), n).alias("ham"),
        n.alias("total_samples"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_count, null_ratio) of every column, in one pass."""
    columns = list(columns or df.columns)
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["_n"], columns, "column", "null_count").select(
        "column", "null_count", ratio(F.col("null_count"), F.col("_n")).alias("null_ratio")
    )


def fill_numeric_nulls(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numeric NULLs become 0 in both splits as soon as the training split has any NULL."""
    nulls = train.agg(*[F.max(F.col(c).isNull()).alias(c) for c in train.columns]).first()
    if not any(nulls):
        return train, test
    columns = [c for c in numeric_columns(train)]
    return train.fillna(0, columns), test.fillna(0, [c for c in columns if c in test.columns])


def scoring_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("spam_label") == 1).alias("spam_count"),
        F.count_if(F.col("spam_label") == 0).alias("ham_count"),
        F.avg("spam_probability").alias("mean_probability"),
    )


def result_summary(scored: DataFrame) -> DataFrame:
    """Counts, percentages and five fixed probability bins of a scored table."""
    p, n = F.col("spam_probability"), F.count(F.lit(1))
    spam = F.count_if(F.col("spam_label") == 1)
    zero = F.lit(0.0)
    bins = {
        "very_low_0_20": p < 0.2,
        "low_20_40": (p >= 0.2) & (p < 0.4),
        "medium_40_60": (p >= 0.4) & (p < 0.6),
        "high_60_80": (p >= 0.6) & (p < 0.8),
        "very_high_80_100": p >= 0.8,
    }
    return scored.agg(
        n.alias("total_records"),
        spam.alias("spam_count"),
        F.count_if(F.col("spam_label") == 0).alias("ham_count"),
        F.round(ratio(spam, n) * 100, 2).alias("spam_percentage"),
        F.coalesce(F.round(F.avg(p), 4), zero).alias("avg_spam_probability"),
        F.coalesce(F.round(F.min(p), 4), zero).alias("min_spam_probability"),
        F.coalesce(F.round(F.max(p), 4), zero).alias("max_spam_probability"),
        *[F.count_if(cond).alias(name) for name, cond in bins.items()],
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Positive weight (1−r)/r and balanced weights n/(2·n_c) from the 0/1 label mix."""
    n, pos = F.count(label).cast("double"), F.count_if(F.col(label) == 1).cast("double")
    row = df.agg(n.alias("n"), pos.alias("pos"))
    neg = F.col("n") - F.col("pos")
    return row.select(
        ratio(F.col("pos"), F.col("n")).alias("spam_ratio"),
        ratio(neg, F.col("pos"), None).alias("positive_weight"),
        ratio(F.col("n"), neg * 2, None).alias("weight_0"),
        ratio(F.col("n"), F.col("pos") * 2, None).alias("weight_1"),
    )


def slice_accuracy(scored: DataFrame, category: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.count_if(F.col(label) == F.col(prediction))
    n = F.count(F.lit(1))
    return scored.groupBy(category).agg(hit.alias("correct"), n.alias("total"), ratio(hit, n).alias("accuracy"))


def slice_report(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", config: SliceConfig = SliceConfig()
) -> DataFrame:
    """Overall accuracy, error rates and the pass flag of the slice check."""
    y, p = F.col(label), F.col(prediction)
    counts = scored.agg(
        F.count_if(y == 1).alias("spam_total"),
        F.count_if(y == 0).alias("ham_total"),
        F.count_if((y == 1) & (p == 1)).alias("spam_correct"),
        F.count_if((y == 0) & (p == 0)).alias("ham_correct"),
    )
    c = F.col
    rates = counts.select(
        "*",
        ratio(c("spam_correct") + c("ham_correct"), c("spam_total") + c("ham_total")).alias("overall_accuracy"),
        ratio(c("spam_correct"), c("spam_total")).alias("spam_accuracy"),
        ratio(c("ham_correct"), c("ham_total")).alias("ham_accuracy"),
        ratio(c("ham_total") - c("ham_correct"), c("ham_total")).alias("false_positive_rate"),
        ratio(c("spam_total") - c("spam_correct"), c("spam_total")).alias("false_negative_rate"),
    )
    return rates.withColumn(
        "passed",
        (c("overall_accuracy") >= config.min_accuracy)
        & (c("false_positive_rate") <= config.max_false_positive_rate)
        & (c("ham_accuracy") >= config.min_ham_accuracy),
    )


def misclassified(scored: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """False positives and false negatives as rows, so their number is unbounded."""
    kind = F.when(F.col(prediction) == 1, "false_positive").otherwise("false_negative")
    return scored.where(F.col(label) != F.col(prediction)).select(key, kind.alias("kind"))


def _moments_of_pairs(columns: Sequence[str]):
    """Per task and column pair: rows with both values, means, and sums of products about the means."""
    left, right = np.triu_indices(len(columns), 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, sums = None, None
        for part in parts:
            x = np.column_stack([np.asarray(part.column(c).cast(pa.float64()).fill_null(np.nan)) for c in columns])
            if not len(x):
                continue
            there = ~np.isnan(x)
            if origin is None:  # products about a point near the data keep their digits
                origin = np.where(there, x, 0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
                origin[~np.isfinite(origin)] = 0
                sums = [np.zeros((len(columns), len(columns))) for _ in range(4)]
            m, z = there.astype(float), np.where(there, x - origin, 0)
            for total, product in zip(sums, (m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z)):
                total += product
        if origin is None:
            return
        n, first, second, cross = sums
        n_of, a, b = n[left, right], first[left, right], first[right, left]
        some = np.maximum(n_of, 1)
        columns_out = {
            "i": left.astype("i4"), "j": right.astype("i4"), "n": n_of.astype("i8"), "ma": origin[left] + a / some, "mb": origin[right] + b / some,
            "caa": second[left, right] - a * a / some, "cbb": second[right, left] - b * b / some, "cab": cross[left, right] - a * b / some,
        }
        yield pa.record_batch({k: pa.array(v) for k, v in columns_out.items()})

    return run


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, correlation): Pearson correlation of every column pair over the rows that have both values.

    Tasks sum products of whole blocks of rows, one matrix product for all pairs, and send one row per pair; so hundreds of
    columns are one pass and one small aggregate. NULL without two rows or without spread.
    """
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string, correlation double")
    rows = df.select(*[nan_to_null(c).cast("double").alias(c) for c in columns])
    parts = rows.mapInArrow(_moments_of_pairs(columns), "i int, j int, n long, ma double, mb double, caa double, cbb double, cab double")
    # Means of tasks are compared with the least of their pair, so that large values lose no digits.
    pair = Window.partitionBy("i", "j")
    parts = parts.where("n > 0").withColumns({c: F.col(c) - F.min(c).over(pair) for c in ("ma", "mb")})
    n, w = F.sum("n"), F.col("n")
    between = lambda x, y: F.sum(w * F.col(x) * F.col(y)) - F.sum(w * F.col(x)) * F.sum(w * F.col(y)) / F.nullif(n, F.lit(0))
    pairs = parts.groupBy("i", "j").agg(
        n.alias("n"), (F.sum("caa") + between("ma", "ma")).alias("caa"), (F.sum("cbb") + between("mb", "mb")).alias("cbb"),
        (F.sum("cab") + between("ma", "mb")).alias("cab"),
    )
    size = len(columns)
    grid = df.sparkSession.range(size * size).select((F.col("id") / size).cast("int").alias("i"), (F.col("id") % size).cast("int").alias("j"))
    pairs = grid.where("i < j").join(F.broadcast(pairs), ["i", "j"], "left")  # one row a pair
    names = F.array(*[F.lit(c) for c in columns])
    spread = F.sqrt(F.col("caa")) * F.sqrt(F.col("cbb"))
    value = F.when((F.col("n") > 1) & (F.col("caa") > 0) & (F.col("cbb") > 0), F.greatest(F.least(F.col("cab") / F.nullif(spread, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)))
    return pairs.select(F.get(names, F.col("i")).alias("left"), F.get(names, F.col("j")).alias("right"), value.alias("correlation"))


def extraction_summary(features: DataFrame, senders: DataFrame, vocabulary_size: int) -> DataFrame:
    """One row describing a feature-extraction run."""
    domains = senders.agg(F.count(F.lit(1))).scalar()
    return features.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == "spam").alias("spam_count"),
        F.count_if(F.col("label") == "ham").alias("ham_count"),
    ).select(
        "*",
        F.lit(len(features.columns)).alias("columns"),
        domains.alias("sender_domains"),
        F.lit(vocabulary_size).alias("vocabulary_size"),
    )
