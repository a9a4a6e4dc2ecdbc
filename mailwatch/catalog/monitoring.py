"""Daily drift reports over the event log, and everything read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.distribution import histogram, moments, to_long
from ..operators.ranking import alert_payload
from ..plans import alerting, detection
from ..plans.baseline import baseline_table, generate_baseline
from ..sources.logs import in_window, wide_features
from ..sources.reports import recent_reports
from ..streaming.windows import sliding_bin_counts, window_psi
from .aggregates import _rounded
from .drift import BASE_HIST_SQL, STATS_SQL
from .views import LOGS_SQL, LONG_SQL, SPLIT, baseline_long, k_value, logs, moment, table, with_views

# --- daily reports --------------------------------------------------------------------


def daily_values(spark, sf: str) -> DataFrame:
    """(timestamp, feature, value) of the whole month; value × 1.5 for even users from the split on."""
    moved = (F.col("ts") >= moment(SPLIT)) & (F.col("user_id") % 2 == 0)
    value = F.when(moved, F.col("value") * 1.5).otherwise(F.col("value"))
    cells = F.array(
        F.struct(F.lit("value").alias("feature"), value.alias("value")),
        F.struct(F.lit("k").alias("feature"), k_value().cast("double").alias("value")),
    )
    return table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.inline(cells))


def daily_feature_drift(spark, sf: str) -> DataFrame:
    """One row per day and feature: PSI against the first half month, means, flag."""
    base = baseline_long(spark, sf)
    hist, values = histogram(base), daily_values(spark, sf)
    psi = window_psi(sliding_bin_counts(values, hist, "1 day", "1 day"), hist)
    stats = F.broadcast(moments(base).select("feature", F.col("mean").alias("baseline_mean"), "min", "max"))
    outside = (F.col("value") < F.col("min")) | (F.col("value") > F.col("max"))
    day = F.window("timestamp", "1 day").alias("w")
    means = values.join(stats, "feature").groupBy(day, "feature", "baseline_mean").agg(
        F.avg("value").alias("current_mean"), F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("n_outside")
    )
    rows = means.select("*", F.col("w.start").alias("window_start")).join(psi, ["window_start", "feature"])
    return rows.select(
        F.concat(F.lit("r-"), F.date_format("window_start", "yyyyMMdd")).alias("report_id"),
        "window_start",
        "window_end",
        "feature",
        F.round("psi", 6).alias("psi"),
        (F.round("psi", 6) > 0.2).alias("drift_detected"),
        F.round("baseline_mean", 6).alias("baseline_mean"),
        F.round("current_mean", 6).alias("current_mean"),
        "n",
        "n_outside",
    )


def daily_reports(spark, sf: str) -> DataFrame:
    """One report row per day, alternating between two models."""
    drift = daily_feature_drift(spark, sf)
    n_hit = F.count_if("drift_detected")
    rows = drift.groupBy("report_id", "window_start", "window_end").agg(
        F.round(F.lit(1.0) - F.exp(-F.avg("psi")), 6).alias("drift_score"),
        F.max(F.when(F.col("feature") == "k", F.col("psi"))).alias("prediction_psi"),
        n_hit.alias("features_drifted_count"),
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))).alias("features_drifted_names"),
        F.max("n").alias("num_samples"),
        F.round(ratio(F.sum("n_outside"), F.sum("n")) * 100, 6).alias("out_of_range_pct"),
    )
    odd = F.dayofmonth("window_start") % 2 == 1
    return rows.select(
        "*",
        F.when(odd, "model_a").otherwise("model_b").alias("model_name"),
        F.lit("1").alias("model_version"),
        F.col("window_end").alias("generated_at"),
        F.lit(0.0).alias("missing_values_pct"),
        (F.col("out_of_range_pct") > 1.0).alias("issues_detected"),
        detection.overall_drift(F.col("drift_score"), F.col("features_drifted_count"), F.col("prediction_psi") > 0.2).alias(
            "overall_drift_detected"
        ),
    )


DAILY_SQL = """
dv AS (
  SELECT ts, 'value' AS feature, CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' AND user_id % 2 = 0 THEN value * 1.5e0 ELSE value END AS value FROM ev
  UNION ALL SELECT ts, 'k', k FROM ev
),
dedges AS (SELECT feature, min(bin_start) AS elo, max(bin_end) AS ehi FROM hist GROUP BY feature),
dbin AS (
  SELECT date_trunc('day', ts) AS d, feature, CAST(least(floor((value - elo) * 20.0e0 / (ehi - elo)), 19) AS INTEGER) AS bin, count(*) AS nc
  FROM dv JOIN dedges USING (feature) WHERE value >= elo AND value <= ehi GROUP BY 1, 2, 3
),
dtot AS (SELECT d, feature, sum(nc) AS t FROM dbin GROUP BY 1, 2),
dgrid AS (
  SELECT dtot.d, dtot.feature, least(greatest(h.density, 1e-6), 1.0e0) AS b,
    least(greatest(CAST(coalesce(nc, 0) AS DOUBLE) / t, 1e-6), 1.0e0) AS c
  FROM dtot JOIN hist h ON h.feature = dtot.feature
  LEFT JOIN dbin ON dbin.d = dtot.d AND dbin.feature = h.feature AND dbin.bin = h.bin
),
dpsi AS (
  SELECT d, feature, round(sum((c / sc - b / sb) * ln((c / sc) / (b / sb))), 6) AS psi FROM (
    SELECT *, sum(b) OVER w AS sb, sum(c) OVER w AS sc FROM dgrid WINDOW w AS (PARTITION BY d, feature)) GROUP BY 1, 2
),
fdrift AS (
  SELECT 'r-' || strftime(d, '%Y%m%d') AS report_id, d AS window_start, d + INTERVAL 1 DAY AS window_end, feature, psi,
    psi > 0.2 AS drift_detected, round(mean, 6) AS baseline_mean, round(current_mean, 6) AS current_mean, n, n_outside
  FROM dpsi JOIN (
    SELECT date_trunc('day', ts) AS d, feature, any_value(mean) AS mean, avg(value) AS current_mean, count(*) AS n,
      count(*) FILTER (value < min OR value > max) AS n_outside
    FROM dv JOIN st USING (feature) GROUP BY 1, 2) m USING (d, feature)
),
reports AS (
  SELECT *, CASE WHEN day(window_start) % 2 = 1 THEN 'model_a' ELSE 'model_b' END AS model_name, '1' AS model_version,
    window_end AS generated_at, 0.0e0 AS missing_values_pct, out_of_range_pct > 1.0 AS issues_detected,
    drift_score >= 0.2 OR features_drifted_count >= 3 OR prediction_psi > 0.2 AS overall_drift_detected
  FROM (
    SELECT report_id, window_start, window_end, round(1 - exp(-avg(psi)), 6) AS drift_score, max(psi) FILTER (feature = 'k') AS prediction_psi,
      count(*) FILTER (drift_detected) AS features_drifted_count,
      coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (drift_detected), '') AS names,
      max(n) AS num_samples, round(CAST(sum(n_outside) AS DOUBLE) / sum(n) * 100, 6) AS out_of_range_pct
    FROM fdrift GROUP BY 1, 2, 3)
)"""
_R = (LONG_SQL, BASE_HIST_SQL, STATS_SQL, DAILY_SQL)

ALERTS_SQL = """
alerts AS (
  SELECT report_id, 1 AS rule_order, 'critical' AS severity, CAST(NULL AS VARCHAR) AS feature,
    printf('Critical drift detected: overall drift score %.2f%% exceeds threshold 50%%', drift_score * 100) AS message,
    'Immediate investigation required. Consider pausing model predictions and initiating retraining.' AS recommendation,
    'drift_score' AS metric_name, drift_score AS metric_value, 0.5e0 AS threshold FROM reports WHERE drift_score >= 0.5
  UNION ALL
  SELECT report_id, 1, 'warning', NULL, printf('Drift detected: overall drift score %.2f%% exceeds threshold 20%%', drift_score * 100),
    'Monitor closely and consider scheduling model retraining.', 'drift_score', drift_score, 0.2e0
  FROM reports WHERE drift_score >= 0.2 AND drift_score < 0.5
  UNION ALL
  SELECT report_id, 2, 'critical', 'prediction_probability', printf('Critical prediction drift: PSI %.3f exceeds threshold 0.3', prediction_psi),
    'Model predictions may be unreliable. Review recent model outputs and consider retraining.', 'prediction_psi', prediction_psi, 0.3e0
  FROM reports WHERE prediction_psi >= 0.3
  UNION ALL
  SELECT report_id, 3, 'warning', NULL, 'Multiple features drifted: ' || features_drifted_count || ' features show drift',
    'Investigate data pipeline for changes. Drifted features: ' || replace(names, ',', ', '), 'features_drifted_count',
    CAST(features_drifted_count AS DOUBLE), CAST({many} AS DOUBLE) FROM reports WHERE features_drifted_count >= {many}
  UNION ALL
  SELECT report_id, 4, 'warning', feature, printf('Feature drift detected: %s has PSI %.3f', feature, psi),
    printf('Investigate changes in %s. Mean shifted from %.3f to %.3f', feature, baseline_mean, current_mean),
    'feature_psi', psi, 0.2e0 FROM fdrift WHERE drift_detected AND psi >= 0.2
  UNION ALL
  SELECT report_id, 6, 'warning', NULL, printf('Data quality issue: %.1f%% out-of-range values', out_of_range_pct),
    'Investigate data source for anomalies or schema changes.', 'out_of_range_pct', out_of_range_pct, 1.0e0
  FROM reports WHERE issues_detected AND out_of_range_pct > 1.0
)"""


def _alerts(spark, sf, many: int = 3):
    config = alerting.DriftConfig(drifted_features=many)
    return alerting.generate_alerts(daily_reports(spark, sf), daily_feature_drift(spark, sf), config)


def _flat(reports: DataFrame) -> DataFrame:
    return reports.withColumn("names", F.array_join("features_drifted_names", ",")).drop("features_drifted_names")


def _recent(spark, sf):
    return recent_reports(daily_reports(spark, sf), F.to_date(F.lit("2024-01-29")), 7).select(
        "report_id", "generated_at", "model_name", "drift_score"
    )


def _payload(spark, sf):
    alerts = _alerts(spark, sf)
    rows = alert_payload(alerts, ["report_id"], daily_feature_drift(spark, sf))
    return rows.select(
        "report_id", "severity", "alerts_count",
        F.array_join(F.transform("alerts", lambda a: a["metric_name"]), ",").alias("metrics"),
        F.coalesce(F.array_join("drifted_features", ","), F.lit("")).alias("drifted"),
    )


def _status(spark, sf):
    """Status of every model that scored events, one of which has no report."""
    models = table(spark, sf, "events").select(
        F.when(F.dayofmonth("ts") % 2 == 1, "model_a").when(F.hour("ts") == 0, "model_c").otherwise("model_b").alias("model_name")
    ).distinct()
    return detection.status_of(models, daily_reports(spark, sf))


def _summary(spark, sf):
    return detection.report_summary(daily_reports(spark, sf), _alerts(spark, sf))


def _feature_history(spark, sf):
    return detection.feature_history(daily_reports(spark, sf), daily_feature_drift(spark, sf), "value")


# --- whole jobs -----------------------------------------------------------------------


def _log_baseline(spark, sf):
    """Profile of the first half month's log: two features and the probability."""
    first = in_window(logs(spark, sf), moment("2024-01-01 00:00:00"), moment("2024-01-15 23:59:59"))
    wide = wide_features(first, ["value", "k"])
    return wide, generate_baseline(
        wide, ["value", "k"], "spam-detector", "1", moment(SPLIT), label="prediction", probability="spam_probability"
    )


def _baseline_job(spark, sf):
    _, base = _log_baseline(spark, sf)
    flat = baseline_table(base, "spam-detector", "1", moment(SPLIT))
    return flat.select("model_name", "model_version", "feature", "mean", "std", "median", "unique_count", F.size("bins").alias("n_bins"))


def detect(spark, sf):
    wide, base = _log_baseline(spark, sf)
    found = detection.run_detection(
        base, logs(spark, sf), ["value", "k", "absent"], moment("2024-01-16 00:00:00"), moment("2024-01-31 00:00:00"),
        "drift-20240131", "spam-detector", "1", baseline_rows=to_long(wide, ["value", "k"]),
    )
    # Report and alerts hold their small inputs; the window is not read again.
    found.close()
    return found


def _detection_report(spark, sf):
    report = detect(spark, sf).report
    return _rounded(_flat(report).drop("report_id"), keep=())


_DETECT_SQL = """
w1 AS (SELECT value, CAST(k AS DOUBLE) AS k, spam_probability FROM logs WHERE timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-15 23:59:59'),
w2 AS (SELECT value, CAST(k AS DOUBLE) AS k, spam_probability FROM logs WHERE timestamp BETWEEN TIMESTAMP '2024-01-16 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'),
base AS (SELECT 'value' AS feature, value FROM w1 UNION ALL SELECT 'k', k FROM w1 UNION ALL SELECT 'spam_probability', spam_probability FROM w1),
cur AS (SELECT 'value' AS feature, value FROM w2 UNION ALL SELECT 'k', k FROM w2 UNION ALL SELECT 'spam_probability', spam_probability FROM w2)"""


_DETECTED_SQL = """
fd AS (SELECT feature, p.psi, p.psi > 0.2 OR ks_pvalue < 0.05 AS hit FROM psip p JOIN ks USING (feature)),
scores AS (
  SELECT 1 - exp(-(sum(psi) FILTER (feature <> 'spam_probability') + 2 * sum(psi) FILTER (feature = 'spam_probability'))
      / (count(*) FILTER (feature <> 'spam_probability') + 1)) AS score,
    sum(psi) FILTER (feature = 'spam_probability') AS pp,
    count(*) FILTER (feature <> 'spam_probability' AND hit) AS n_hit,
    coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (feature <> 'spam_probability' AND hit), '') AS names FROM fd
),
quality AS (
  SELECT CAST(count(*) FILTER (value IS NULL) AS DOUBLE) / count(*) * 100 AS m,
    CAST(count(*) FILTER (value < min OR value > max) AS DOUBLE) / count(*) * 100 AS o, count(DISTINCT feature) AS seen
  FROM cur LEFT JOIN st USING (feature) WHERE feature <> 'spam_probability'
)"""


def _detect_sql(*more: str, body: str = "") -> str:
    from .drift import ECDF2_SQL, IN_BINS_SQL, JOINT_SQL, KS_SQL

    return with_views(
        LOGS_SQL, _DETECT_SQL, JOINT_SQL, ECDF2_SQL, KS_SQL, BASE_HIST_SQL, IN_BINS_SQL, STATS_SQL, _DETECTED_SQL, *more,
        body=body or """
SELECT TIMESTAMP '2024-01-31 00:00:00' AS generated_at, 'spam-detector' AS model_name, '1' AS model_version,
  TIMESTAMP '2024-01-16 00:00:00' AS window_start, TIMESTAMP '2024-01-31 00:00:00' AS window_end,
  (SELECT count(*) FROM w2) AS num_samples, (SELECT count(*) FROM w2) < 100 AS insufficient_samples,
  score >= 0.2 OR n_hit >= 3 OR pp > 0.2 AS overall_drift_detected, round(score, 6) AS drift_score, CAST(3 AS BIGINT) AS total_features,
  n_hit AS features_drifted_count, names, round(pp, 6) AS prediction_psi, round(m, 6) AS missing_values_pct, round(o, 6) AS out_of_range_pct,
  3 - seen AS null_features_count, m > 5 OR o > 1 AS issues_detected
FROM scores, quality""",
    )


def _detect_alerts_sql() -> str:
    return _detect_sql(
        """reports AS (
  SELECT 'drift-20240131' AS report_id, score AS drift_score, pp AS prediction_psi, n_hit AS features_drifted_count, names,
    o AS out_of_range_pct, m > 5 OR o > 1 AS issues_detected FROM scores, quality
),
fdrift AS (
  SELECT 'drift-20240131' AS report_id, feature, psi, hit AS drift_detected, b.mean AS baseline_mean, c.mean AS current_mean
  FROM fd JOIN (SELECT feature, avg(value) AS mean FROM base GROUP BY 1) b USING (feature)
  JOIN (SELECT feature, avg(value) AS mean FROM cur GROUP BY 1) c USING (feature) WHERE feature <> 'spam_probability'
)""",
        ALERTS_SQL.replace("{many}", "3"),
        body="SELECT * REPLACE (round(metric_value, 6) AS metric_value) FROM alerts",
    )


def _detection_alerts(spark, sf):
    return _rounded(detect(spark, sf).alerts, keep=())


QUERIES = {
    "a10_recent_reports": (
        _recent,
        with_views(
            *_R,
            body="""SELECT report_id, generated_at, model_name, drift_score FROM reports
                    WHERE CAST(generated_at AS DATE) > DATE '2024-01-22' AND CAST(generated_at AS DATE) <= DATE '2024-01-29'""",
        ),
    ),
    "f14_history_summary": (
        lambda spark, sf: _rounded(detection.history_summary(daily_reports(spark, sf)), keep=()),
        with_views(
            *_R,
            body="""SELECT round(avg(drift_score), 6) AS avg_drift_score, round(max(drift_score), 6) AS max_drift_score,
                      count(*) FILTER (overall_drift_detected) AS drift_detected_count, count(*) AS total_reports
                    FROM (SELECT * FROM reports ORDER BY generated_at DESC, report_id DESC LIMIT 100)""",
        ),
    ),
    "g17_overall_drift": (
        lambda spark, sf: _flat(daily_reports(spark, sf)).select("report_id", "drift_score", "features_drifted_count", "names", "overall_drift_detected"),
        with_views(*_R, body="SELECT report_id, drift_score, features_drifted_count, names, overall_drift_detected FROM reports"),
    ),
    "g18_small_samples": (
        lambda spark, sf: daily_reports(spark, sf).select(
            "report_id", (F.col("num_samples") < alerting.DriftConfig().min_samples).alias("insufficient_samples")
        ),
        with_views(*_R, body="SELECT report_id, num_samples < 100 AS insufficient_samples FROM reports"),
    ),
    "g19_alerts": (
        lambda spark, sf: _alerts(spark, sf, many=1),
        with_views(*_R, ALERTS_SQL.replace("{many}", "1"), body="SELECT * FROM alerts"),
    ),
    "g21_status": (
        _status,
        with_views(
            *_R,
            """models AS (SELECT DISTINCT CASE WHEN day(ts) % 2 = 1 THEN 'model_a' WHEN hour(ts) = 0 THEN 'model_c' ELSE 'model_b' END AS model_name FROM events),
               lastr AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY generated_at DESC, report_id DESC) = 1)""",
            body="""SELECT model_name, CASE WHEN drift_score IS NULL THEN 'unknown' WHEN drift_score >= 0.5 THEN 'critical'
                        WHEN overall_drift_detected THEN 'warning' ELSE 'healthy' END AS status,
                      coalesce(overall_drift_detected, false) AS drift_detected, coalesce(drift_score, 0.0e0) AS drift_score, generated_at AS last_checked
                    FROM models LEFT JOIN lastr USING (model_name)""",
        ),
    ),
    "g22_report_summary": (
        _summary,
        with_views(
            *_R, ALERTS_SQL.replace("{many}", "3"),
            body="""SELECT model_name, model_version, generated_at AS last_checked, overall_drift_detected AS drift_detected, drift_score,
                      names AS features_drifted, coalesce(n, 0) AS alerts_count, num_samples AS samples_analyzed,
                      CASE WHEN coalesce(crit, false) THEN 2 WHEN overall_drift_detected THEN 1 ELSE 0 END AS exit_class
                    FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY generated_at DESC, report_id DESC) = 1) r
                    LEFT JOIN (SELECT report_id, count(*) AS n, bool_or(severity = 'critical') AS crit FROM alerts GROUP BY 1) a USING (report_id)""",
        ),
    ),
    "g24_detection_report": (_detection_report, _detect_sql()),
    "g24_detection_alerts": (_detection_alerts, _detect_alerts_sql()),
    "g25_monitoring_summary": (
        lambda spark, sf: _rounded(detection.monitoring_summary(daily_reports(spark, sf)), keep=()),
        with_views(
            *_R,
            body="""SELECT report_id, drift_score AS feature_drift_score, round(1 - exp(-prediction_psi), 6) AS prediction_drift_score,
                      round(greatest(least(1 - out_of_range_pct / 100, 1.0e0), 0.0e0), 6) AS data_quality_score,
                      overall_drift_detected AS drift_detected, names AS drifted_features, window_start, window_end FROM reports""",
        ),
    ),
    "f08_baseline": (
        lambda spark, sf: _rounded(_baseline_job(spark, sf)),
        with_views(
            LOGS_SQL, _DETECT_SQL,
            body="""SELECT 'spam-detector' AS model_name, '1' AS model_version, feature, round(avg(value), 6) AS mean,
                      round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median,
                      count(DISTINCT value) AS unique_count, 20 AS n_bins FROM base GROUP BY feature""",
        ),
    ),
    "s04_alert_payload": (
        _payload,
        with_views(
            *_R, ALERTS_SQL.replace("{many}", "3"),
            body="""SELECT report_id, severity, alerts_count, metrics, coalesce(drifted, '') AS drifted FROM (
                      SELECT report_id, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity,
                        count(*) AS alerts_count, string_agg(metric_name, ',' ORDER BY rule_order, severity, message, metric_name) AS metrics
                      FROM alerts GROUP BY 1) a
                    LEFT JOIN (SELECT report_id, string_agg(feature, ',' ORDER BY feature) AS drifted FROM fdrift WHERE drift_detected GROUP BY 1) f
                    USING (report_id)""",
        ),
    ),
    "w05_feature_history": (
        _feature_history,
        with_views(
            *_R,
            body="""SELECT feature, generated_at AS timestamp, psi, drift_detected FROM fdrift
                    JOIN (SELECT report_id, generated_at FROM reports ORDER BY generated_at DESC, report_id DESC LIMIT 20) USING (report_id)
                    WHERE feature = 'value'""",
        ),
    ),
    "w06_latest_report": (
        lambda spark, sf: detection.latest_report(daily_reports(spark, sf)).select("model_name", "report_id", "generated_at", "drift_score"),
        with_views(
            *_R,
            body="""SELECT model_name, report_id, generated_at, drift_score FROM reports
                    QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY generated_at DESC, report_id DESC) = 1""",
        ),
    ),
}
