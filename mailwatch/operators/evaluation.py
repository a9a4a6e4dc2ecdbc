"""Classifier metrics from (label, prediction, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .distribution import to_long
from .ordered import exact_quantiles, running_totals


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def _score_steps(scored: DataFrame, label: str, score: str, ranges: int | None) -> DataFrame:
    """Per distinct score: positives, negatives, and how many of each lie below."""
    y, s = F.col(label), F.col(score)
    rows = scored.where(s.isNotNull() & y.isin(0, 1)).select(
        F.lit("score").alias("feature"), s.cast("double").alias("value"), y.alias("_y")
    )
    counts = rows.groupBy("feature", "value").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")
    )
    run = running_totals(counts, ["feature"], "value", ["pos", "neg"], ranges)
    return run.withColumnsRenamed({"total_pos": "p_total", "total_neg": "n_total"})


def auc(scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None) -> DataFrame:
    """Exact tie-aware area under the ROC curve; NULL when only one class is present."""
    steps = _score_steps(scored, label, score, ranges)
    wins = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg").cast("double") / 2)
    pairs = F.first("p_total").cast("double") * F.first("n_total").cast("double")
    return steps.agg(ratio(F.sum(wins), pairs, None).alias("auc_roc"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn),
    }


def metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", score: str | None = "score",
    ranges: int | None = None,
) -> DataFrame:
    """One row: accuracy, precision, recall, F1 (positive class 1) and AUC."""
    y, p = F.col(label), F.col(prediction)
    counts = scored.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    row = counts.select(*[c.alias(n) for n, c in rates.items()])
    if score is None:
        return row
    return row.withColumn("auc_roc", auc(scored, label, score, ranges).scalar())


def metrics_by(
    scored: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction", score: str = "score",
    ranges: int | None = None,
) -> DataFrame:
    """The measures of :func:`metrics` for every group, of all groups in the same aggregates."""
    y, p, s = F.col(label), F.col(prediction), F.col(score)
    rates = _rates(
        F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0)), F.count_if((y == 0) & (p == 0))
    )
    rows = scored.where(s.isNotNull() & y.isin(0, 1))
    counts = rows.groupBy(*keys, s.cast("double").alias("value")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    steps = running_totals(counts, keys, "value", ["pos", "neg"], ranges)
    wins = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg").cast("double") / 2))
    pairs = F.first("total_pos").cast("double") * F.first("total_neg").cast("double")
    areas = steps.groupBy(*keys).agg(ratio(wins, pairs, None).alias("auc_roc"))
    return scored.groupBy(*keys).agg(*[c.alias(n) for n, c in rates.items()]).join(areas, keys, "left")


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class and as macro / weighted means: precision, recall, F1, support."""
    y, p = F.col(label), F.col(prediction)
    hits = [
        F.struct(
            F.lit(str(k)).alias("class"),
            F.count_if((y == k) & (p == k)).alias("tp"),
            F.count_if((y != k) & (p == k)).alias("fp"),
            F.count_if((y == k) & (p != k)).alias("fn"),
        )
        for k in (0, 1)
    ]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = scored.agg(F.array(*hits).alias("r")).select(F.inline("r")).select(
        "class",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
    )
    names = ["precision", "recall", "f1"]
    support = F.sum("support")
    # Both averages in one pass over the two class rows.
    means = per.agg(
        F.array(
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], support.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[ratio(F.sum(F.col(c) * F.col("support")), support).alias(c) for c in names],
                support.alias("support"),
            ),
        ).alias("r")
    ).select(F.inline("r"))
    return per.unionByName(means)


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None) -> DataFrame:
    """One point per distinct threshold: rows with score ≥ threshold are called positive."""
    steps = _score_steps(scored, label, score, ranges)
    return steps.select(
        F.col("value").alias("threshold"),
        ratio(F.col("n_total") - F.col("before_neg"), F.col("n_total")).alias("fpr"),
        ratio(F.col("p_total") - F.col("before_pos"), F.col("p_total")).alias("tpr"),
    )


def precision_recall_curve(
    scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None
) -> DataFrame:
    steps = _score_steps(scored, label, score, ranges)
    tp = F.col("p_total") - F.col("before_pos")
    fp = F.col("n_total") - F.col("before_neg")
    return steps.select(
        F.col("value").alias("threshold"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("p_total")).alias("recall"),
    )


def score_parity(
    a: DataFrame, b: DataFrame, key: str, score: str = "score", max_diff: float = 0.001, min_match: float = 0.99,
    ranges: int | None = None,
) -> DataFrame:
    """Differences of two scorings of the same rows, with the pass flag."""
    joined = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key)
    diffs = joined.select(F.abs(F.col("_a") - F.col("_b")).alias("diff"), ((F.col("_a") > 0.5) == (F.col("_b") > 0.5)).alias("same"))
    p99 = exact_quantiles(to_long(diffs, ["diff"]), {"q": 0.99}, ranges=ranges).select("q").scalar()
    row = diffs.agg(
        F.max("diff").alias("max_diff"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_pop("diff").alias("std_diff"),
        ratio(F.count_if("same"), F.count(F.lit(1))).alias("label_match_rate"),
    )
    return row.withColumn("p99_diff", p99).withColumn(
        "passed", (F.col("max_diff") <= max_diff) & (F.col("label_match_rate") >= min_match)
    )
