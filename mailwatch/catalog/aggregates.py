"""Grouped counts, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import SCALARS, feature_rows
from ..operators import aggregates as A
from ..operators import distribution as dist
from ..operators import tfidf
from ..operators.distribution import to_long
from ..sources.tables import spread
from .features import SQL_TRAIN
from .joins import SENDERS_SQL
from .textual import _sql as tfidf_sql
from .views import (
    EMAILS_SQL, JOB_TIME, LOGS_SQL, PREDICTIONS_SQL, SCORED_SQL, emails, logs, moment, predictions, scored, table,
    with_views,
)

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

LINE_LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS feature, {m} AS value FROM lineitem" for m in MEASURES) + ")"
BINS = """
lim AS (SELECT feature, min(value) AS lo0, max(value) AS hi0 FROM long WHERE value IS NOT NULL GROUP BY feature),
rng AS (SELECT feature, CASE WHEN lo0 = hi0 THEN lo0 - 0.5e0 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5e0 ELSE hi0 END AS hi FROM lim),
cnt AS (SELECT feature, CAST(least(floor((value - lo) * {n}e0 / (hi - lo)), {n} - 1) AS INTEGER) AS bin, count(*) AS n
  FROM long JOIN rng USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2),
hist AS (
  SELECT feature, CAST(b AS INTEGER) AS bin, lo + b * ((hi - lo) / {n}e0) AS bin_start,
    CASE WHEN b = {n} - 1 THEN hi ELSE lo + (b + 1) * ((hi - lo) / {n}e0) END AS bin_end,
    coalesce(n, 0) AS count, CAST(coalesce(n, 0) AS DOUBLE) / sum(coalesce(n, 0)) OVER (PARTITION BY feature) AS density
  FROM (SELECT feature, lo, hi, unnest(range({n})) AS b FROM rng) g
  LEFT JOIN cnt ON cnt.feature = g.feature AND cnt.bin = g.b
)"""


def hist_sql(bins: int = 20) -> str:
    # LEFT JOIN … ON keeps both key columns; the grid's feature is the one selected.
    return BINS.replace("{n}", str(bins)).replace(
        "SELECT feature, CAST(b AS INTEGER)", "SELECT g.feature, CAST(b AS INTEGER)"
    ).replace("PARTITION BY feature) AS density", "PARTITION BY g.feature) AS density")


def _lines(spark, sf):
    return to_long(spread(table(spark, sf, "lineitem").select("l_orderkey", *MEASURES), "l_orderkey"), MEASURES)


def _rounded(df, digits: int = 6, keep=("feature",)):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes]
    )


def _null_profile(spark, sf):
    rows = emails(spark, sf)
    return A.null_profile(rows, ["subject", "x_mailer", "received_hop_count", "date", "body_html", "label"])


def _null_fill(spark, sf):
    mails = emails(spark, sf, html=False).select("email_id", "received_hop_count", "x_mailer")
    filled, _ = A.fill_numeric_nulls(mails, mails)
    return filled


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*) AS null_ratio FROM emails"
    for c in ["subject", "x_mailer", "received_hop_count", "date", "body_html", "label"]
)

_STATS_SQL = """SELECT feature, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std, round(min(value), 7) AS min, round(max(value), 7) AS max,
  round(quantile_cont(value, 0.25), 7) AS q25, round(quantile_cont(value, 0.5), 7) AS median, round(quantile_cont(value, 0.75), 7) AS q75,
  count(*) FILTER (value IS NULL) AS missing_count, CAST(count(*) FILTER (value IS NULL) AS DOUBLE) / count(*) AS missing_ratio,
  count(DISTINCT value) AS unique_count FROM long GROUP BY feature"""

_MAIL_STATS = ["url_count", "word_count", "uppercase_ratio", "hour_of_day", "spam_keyword_count"]


def _mail_statistics(spark, sf):
    rows = feature_rows(emails(spark, sf, html=False, labels=False), moment(JOB_TIME))
    return _rounded(dist.feature_statistics(to_long(rows, _MAIL_STATS)), 7)


def _correlations(spark, sf):
    return _rounded(A.correlations(table(spark, sf, "lineitem"), MEASURES))


_PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]


def _extraction(spark, sf):
    mails = emails(spark, sf)
    rows = feature_rows(mails, moment(JOB_TIME))
    vocabulary = tfidf.fit(table(spark, sf, "documents"), "text")
    return A.extraction_summary(rows, A.sender_features(mails), vocabulary_size=len(vocabulary.terms))


def _predicted_label(spark, sf):
    return scored(spark, sf).select("doc_id", "lang", "label", "prediction")


QUERIES = {
    "f01_sender_features": (
        lambda spark, sf: A.sender_features(emails(spark, sf, html=False)),
        with_views(EMAILS_SQL, SENDERS_SQL, body="SELECT * FROM senders"),
    ),
    "f02_label_distribution": (
        lambda spark, sf: A.label_distribution(emails(spark, sf, html=False)),
        with_views(
            EMAILS_SQL,
            body="SELECT label, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM emails) AS share FROM emails GROUP BY label",
        ),
    ),
    "f03_feature_statistics": (
        lambda spark, sf: _rounded(dist.feature_statistics(_lines(spark, sf)), 7),
        with_views(LINE_LONG_SQL, body=_STATS_SQL),
    ),
    "f03_mail_statistics": (
        _mail_statistics,
        with_views(
            EMAILS_SQL,
            "long AS (" + " UNION ALL ".join(
                f"SELECT '{f}' AS feature, CAST({SQL_TRAIN[f]} AS DOUBLE) AS value FROM emails" for f in _MAIL_STATS
            ) + ")",
            body=_STATS_SQL,
        ),
    ),
    "f03_feature_statistics_approximate": (
        lambda spark, sf: dist.feature_statistics(_lines(spark, sf), approximate=True),
        None,
    ),
    "f04_histogram": (
        lambda spark, sf: _rounded(dist.histogram(_lines(spark, sf))),
        with_views(
            LINE_LONG_SQL, hist_sql(20),
            body="SELECT feature, bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, count, round(density, 6) AS density FROM hist",
        ),
    ),
    "f05_target_distribution": (
        lambda spark, sf: A.target_distribution(emails(spark, sf, html=False)),
        with_views(
            EMAILS_SQL,
            body="""SELECT CAST(count(*) FILTER (label = 'spam') AS DOUBLE) / count(*) AS spam,
                      CAST(count(*) FILTER (label = 'ham') AS DOUBLE) / count(*) AS ham, count(*) AS total_samples FROM emails""",
        ),
    ),
    "f05_target_distribution_numeric": (
        lambda spark, sf: A.target_distribution(table(spark, sf, "labels"), "quality"),
        """SELECT CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*) AS spam,
             CAST(count(*) FILTER (quality = 0) AS DOUBLE) / count(*) AS ham, count(*) AS total_samples FROM labels""",
    ),
    "f06_prediction_distribution": (
        lambda spark, sf: _rounded(dist.prediction_distribution(logs(spark, sf))),
        with_views(
            LOGS_SQL,
            body="""SELECT round(avg(spam_probability), 6) AS mean_probability, round(stddev_pop(spam_probability), 6) AS std_probability,
                      round(quantile_cont(spam_probability, 0.5), 6) AS median_probability FROM logs""",
        ),
    ),
    "f06_prediction_histogram": (
        lambda spark, sf: _rounded(dist.histogram(to_long(logs(spark, sf), ["spam_probability"]))),
        with_views(
            LOGS_SQL, "long AS (SELECT 'spam_probability' AS feature, spam_probability AS value FROM logs)", hist_sql(20),
            body="SELECT feature, bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, count, round(density, 6) AS density FROM hist",
        ),
    ),
    "f07_null_profile": (_null_profile, with_views(EMAILS_SQL, body=_PROFILE_SQL)),
    "f07_null_fill": (
        _null_fill,
        with_views(EMAILS_SQL, body="SELECT email_id, coalesce(received_hop_count, 0) AS received_hop_count, x_mailer FROM emails"),
    ),
    "f09_scoring_summary": (
        lambda spark, sf: _rounded(A.scoring_summary(predictions(spark, sf))),
        with_views(
            PREDICTIONS_SQL,
            body="""SELECT count(*) AS total, count(*) FILTER (spam_label = 1) AS spam_count, count(*) FILTER (spam_label = 0) AS ham_count,
                      round(avg(spam_probability), 6) AS mean_probability FROM predictions""",
        ),
    ),
    "f10_result_summary": (
        lambda spark, sf: A.result_summary(predictions(spark, sf)),
        with_views(
            PREDICTIONS_SQL,
            body="""SELECT count(*) AS total_records, count(*) FILTER (spam_label = 1) AS spam_count, count(*) FILTER (spam_label = 0) AS ham_count,
                      round(CAST(count(*) FILTER (spam_label = 1) AS DOUBLE) / count(*) * 100, 2) AS spam_percentage,
                      round(avg(spam_probability), 4) AS avg_spam_probability, round(min(spam_probability), 4) AS min_spam_probability,
                      round(max(spam_probability), 4) AS max_spam_probability,
                      count(*) FILTER (spam_probability < 0.2) AS very_low_0_20,
                      count(*) FILTER (spam_probability >= 0.2 AND spam_probability < 0.4) AS low_20_40,
                      count(*) FILTER (spam_probability >= 0.4 AND spam_probability < 0.6) AS medium_40_60,
                      count(*) FILTER (spam_probability >= 0.6 AND spam_probability < 0.8) AS high_60_80,
                      count(*) FILTER (spam_probability >= 0.8) AS very_high_80_100 FROM predictions""",
        ),
    ),
    "f16_class_weights": (
        lambda spark, sf: _rounded(A.class_weights(table(spark, sf, "labels"), "quality")),
        """SELECT round(p / n, 6) AS spam_ratio, round((n - p) / p, 6) AS positive_weight, round(n / (2 * (n - p)), 6) AS weight_0,
             round(n / (2 * p), 6) AS weight_1
           FROM (SELECT CAST(count(quality) AS DOUBLE) AS n, CAST(count(*) FILTER (quality = 1) AS DOUBLE) AS p FROM labels)""",
    ),
    "f17_slice_accuracy": (
        lambda spark, sf: A.slice_accuracy(scored(spark, sf), "lang"),
        with_views(
            SCORED_SQL,
            body="""SELECT lang, count(*) FILTER (label = prediction) AS correct, count(*) AS total,
                      CAST(count(*) FILTER (label = prediction) AS DOUBLE) / count(*) AS accuracy FROM scored GROUP BY lang""",
        ),
    ),
    "f17_slice_report": (
        lambda spark, sf: A.slice_report(scored(spark, sf)),
        with_views(
            SCORED_SQL,
            body="""SELECT *, overall_accuracy >= 0.8 AND false_positive_rate <= 0.2 AND ham_accuracy >= 0.7 AS passed FROM (
                      SELECT *, CAST(spam_correct + ham_correct AS DOUBLE) / (spam_total + ham_total) AS overall_accuracy,
                        CAST(spam_correct AS DOUBLE) / spam_total AS spam_accuracy, CAST(ham_correct AS DOUBLE) / ham_total AS ham_accuracy,
                        CAST(ham_total - ham_correct AS DOUBLE) / ham_total AS false_positive_rate,
                        CAST(spam_total - spam_correct AS DOUBLE) / spam_total AS false_negative_rate FROM (
                          SELECT count(*) FILTER (label = 1) AS spam_total, count(*) FILTER (label = 0) AS ham_total,
                            count(*) FILTER (label = 1 AND prediction = 1) AS spam_correct,
                            count(*) FILTER (label = 0 AND prediction = 0) AS ham_correct FROM scored))""",
        ),
    ),
    "f17_misclassified": (
        lambda spark, sf: A.misclassified(_predicted_label(spark, sf), "doc_id"),
        with_views(
            SCORED_SQL,
            body="""SELECT doc_id, CASE WHEN prediction = 1 THEN 'false_positive' ELSE 'false_negative' END AS kind
                    FROM scored WHERE label <> prediction""",
        ),
    ),
    "f18_correlations": (
        _correlations,
        " UNION ALL ".join(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in _PAIRS
        ),
    ),
    "f20_extraction_summary": (
        _extraction,
        with_views(
            EMAILS_SQL,
            body=f"""SELECT count(*) AS rows, count(*) FILTER (label = 'spam') AS spam_count, count(*) FILTER (label = 'ham') AS ham_count,
                       {len(SCALARS) + 3} AS columns, count(DISTINCT sender_domain) AS sender_domains, (SELECT CAST(count(*) AS INTEGER) FROM ({tfidf_sql('SELECT * FROM vocab')})) AS vocabulary_size FROM emails""",
        ),
    ),
}
