"""Sinks and sources as round trips: rows written to the shared folder and what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import TFIDF_SIZE, feature_rows
from ..operators import tfidf
from ..operators.aggregates import sender_features
from ..plans.baseline import baseline_from_table, baseline_table, generate_baseline
from ..plans.feature_store import FeatureStore
from ..session import scratch_folder
from ..sources import logs as log_tables
from ..sources import reports as report_tables
from ..sources import tables
from .drift import BASE_HIST_SQL, STATS_SQL
from .features import SQL_TRAIN
from .joins import SENDERS_SQL
from .monitoring import DAILY_SQL, daily_reports
from .textual import _sql as tfidf_sql
from .views import EMAILS_SQL, JOB_TIME, LOGS_SQL, LONG_SQL, emails, logs, moment, table, with_views


def _by_label(spark, sf):
    path = scratch_folder(spark, "emails")
    tables.write_emails(emails(spark, sf, html=False).where(F.col("label").isNotNull()), path)
    return tables.read_emails(spark, path, "spam").select("email_id", "label", F.length("body_text").alias("chars"))


def _feature_sink(spark, sf):
    path = scratch_folder(spark, "features")
    rows = feature_rows(emails(spark, sf, html=False, labels=False), moment(JOB_TIME))
    tables.write_features(rows.select("email_id", "word_count", "char_count"), path, "email_id")
    return tables.read_columns(spark, path, ["email_id", "word_count"])


def _log_scan(spark, sf):
    """The partitioned log of one and a half days, from its day folders only."""
    path = scratch_folder(spark, "log")
    rows = logs(spark, sf)
    log_tables.write_log(rows, path)
    start, end = moment("2024-01-10 12:00:00"), moment("2024-01-11 23:59:59")
    return log_tables.scan_log(spark, path, start, end, rows.schema).select("inference_id", "timestamp", "prediction")


def _newest_baseline(spark, sf):
    """Two versions are saved; the one created last is loaded."""
    path = scratch_folder(spark, "baseline")
    lines = table(spark, sf, "lineitem")
    for version, at, rows in (("1", "2024-01-01 00:00:00", lines.where("l_linenumber = 1")), ("2", "2024-02-01 00:00:00", lines)):
        base = generate_baseline(rows, ["l_quantity", "l_discount"], "m", version, moment(at), label=None)
        tables.save_baseline(baseline_table(base, "m", version, moment(at)), path)
    stats = baseline_from_table(tables.load_baseline(spark, path, "m")).stats
    return stats.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _report_history(spark, sf):
    path = scratch_folder(spark, "reports")
    report_tables.write_reports(daily_reports(spark, sf), path)
    return report_tables.read_reports(spark, path).select("report_id", "model_name", F.round("drift_score", 6).alias("drift_score"))


def _csv(spark, sf):
    path = scratch_folder(spark, "csv")
    tables.export_csv(sender_features(emails(spark, sf, html=False)).select("sender_domain", "email_count", "spam_count"), path)
    return spark.read.option("header", True).schema("sender_domain string, email_count long, spam_count long").csv(path).select(
        F.coalesce("sender_domain", F.lit("")).alias("sender_domain"), "email_count", "spam_count"
    )


def _artifact(spark, sf):
    path = scratch_folder(spark, "vocabulary")
    tables.save_artifact(tfidf.fit(table(spark, sf, "documents"), "text").to_frame(spark), path)
    model = tfidf.TfidfModel.from_frame(spark.read.parquet(path), tfidf.TfidfConfig())
    return model.to_frame(spark).select("idx", "term", F.round("idf", 6).alias("idf"))


def _registry(spark, sf):
    """The feature views with the rows of their sources, mails and senders."""
    mails = emails(spark, sf, html=False)
    store = FeatureStore({"email_features": mails, "sender_features": sender_features(mails)})
    return store.statistics(spark).select("view", "source", "features", "online", "ttl_days", "rows")


QUERIES = {
    "a04_emails_by_label": (
        _by_label, with_views(EMAILS_SQL, body="SELECT email_id, label, CAST(length(body_text) AS INTEGER) AS chars FROM emails WHERE label = 'spam'"),
    ),
    "a05_feature_sink": (_feature_sink, with_views(EMAILS_SQL, body=f"SELECT email_id, {SQL_TRAIN['word_count']} AS word_count FROM emails")),
    "a07_partitioned_scan": (
        _log_scan,
        with_views(
            LOGS_SQL,
            body="""SELECT inference_id, timestamp, prediction FROM logs
                    WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-11 23:59:59'""",
        ),
    ),
    "a08_newest_baseline": (
        _newest_baseline,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in ("l_quantity", "l_discount")
        ),
    ),
    "a09_report_history": (
        _report_history,
        with_views(LONG_SQL, BASE_HIST_SQL, STATS_SQL, DAILY_SQL, body="SELECT report_id, model_name, drift_score FROM reports"),
    ),
    "a11_csv_export": (_csv, with_views(EMAILS_SQL, SENDERS_SQL, body="SELECT sender_domain, email_count, spam_count FROM senders")),
    "a12_artifact": (_artifact, tfidf_sql("SELECT idx, term, round(idf, 6) AS idf FROM vocab")),
    "j01_registry": (
        _registry,
        with_views(
            EMAILS_SQL, SENDERS_SQL,
            body=f"""SELECT v.*, CASE WHEN source = 'email_features' THEN (SELECT count(*) FROM emails) ELSE (SELECT count(*) FROM senders) END AS rows FROM (
                       VALUES ('email_text_features', 'email_features', 8, true, 365), ('email_structural_features', 'email_features', 8, true, 365),
                         ('email_temporal_features', 'email_features', 4, true, 365), ('email_tfidf_features', 'email_features', {TFIDF_SIZE}, false, 365),
                         ('sender_domain_features', 'sender_features', 4, true, 30)) v(view, source, features, online, ttl_days)""",
        ),
    ),
}
