"""Distribution distances and data quality between two half months of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DriftConfig
from ..functions.features import KEY_FEATURES
from ..functions.labels import psi_band
from ..operators import drift as D
from ..operators import ordered, sketches
from ..operators.distribution import QUARTILES, feature_statistics, histogram, to_long
from ..session import scratch_folder
from .aggregates import _rounded, hist_sql
from .views import LONG_SQL, SPLIT, baseline_long, current_long, k_value, moment, table, with_views

# --- SQL building blocks --------------------------------------------------------------

BASE_HIST_SQL = hist_sql(20).replace("FROM long", "FROM base")
STATS_SQL = """
st AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM base GROUP BY feature),
cm AS (SELECT feature, avg(value) AS current_mean FROM cur GROUP BY feature)"""

JOINT_SQL = """
bth AS (SELECT feature, value, 0 AS side FROM base UNION ALL SELECT feature, value, 1 FROM cur),
sides AS (SELECT feature, count(*) FILTER (side = 0) AS tb, count(*) FILTER (side = 1) AS tc, min(value) AS lo, max(value) AS hi FROM bth GROUP BY feature),
pbin AS (
  SELECT feature, least(floor((value - lo) * 10.0e0 / (hi - lo)), 9) AS bin, tb, tc,
    count(*) FILTER (side = 0) AS nb, count(*) FILTER (side = 1) AS nc
  FROM bth JOIN sides USING (feature) GROUP BY ALL
),
pterm AS (SELECT feature, greatest(nb / CAST(tb AS DOUBLE), 1e-6) AS b, greatest(nc / CAST(tc AS DOUBLE), 1e-6) AS c FROM pbin),
psi AS (SELECT feature, sum((c - b) * ln(c / b)) AS psi FROM pterm GROUP BY feature)"""

ECDF2_SQL = """
vals AS (SELECT feature, value, count(*) FILTER (side = 0) AS nb, count(*) FILTER (side = 1) AS nc FROM bth GROUP BY feature, value),
steps AS (
  SELECT feature, value, tb, tc,
    CAST(sum(nb) OVER w AS DOUBLE) / tb AS fb, CAST(sum(nc) OVER w AS DOUBLE) / tc AS fc,
    lead(value) OVER w - value AS step
  FROM vals JOIN sides USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY value)
)"""

#: Small samples: all merges of n and m values, one value more in each round; what reaches the distance stays there.
KS_SQL = """
kd AS (SELECT feature, max(abs(fb - fc)) AS d, any_value(tb) AS n, any_value(tc) AS m FROM steps GROUP BY feature),
lattice AS (
  SELECT feature, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(round(d * n * m) AS BIGINT) AS h, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, 1.0e0 AS p
  FROM kd WHERE greatest(n, m) <= 1000
  UNION ALL
  SELECT feature, n, m, h, i, j, sum(p) AS p FROM (
    SELECT feature, n, m, h, i + x AS i, j + 1 - x AS j, p * CASE WHEN x = 1 THEN n - i ELSE m - j END / (n + m - i - j) AS p
    FROM lattice, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS step(x) WHERE abs(i * m - j * n) < h AND CASE WHEN x = 1 THEN i < n ELSE j < m END)
  GROUP BY feature, n, m, h, i, j
),
reached AS (SELECT feature, least(sum(p), 1.0e0) AS p FROM lattice WHERE abs(i * m - j * n) >= h GROUP BY feature),
ks AS (
  SELECT feature, d AS ks_statistic, CASE WHEN greatest(n, m) <= 1000 THEN 'exact' ELSE 'asymptotic' END AS ks_method,
    CASE WHEN greatest(n, m) <= 1000 THEN reached.p WHEN lam < 0.2 THEN 1.0e0 ELSE least(greatest(
      list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0e0 ELSE -2.0e0 END * exp(-2.0e0 * k * k * lam * lam))), 0.0e0), 1.0e0) END AS ks_pvalue
  FROM (SELECT *, sqrt(n * CAST(m AS DOUBLE) / (n + m)) * d AS lam FROM kd) LEFT JOIN reached USING (feature)
)"""

IN_BINS_SQL = """
edges AS (SELECT feature, min(bin_start) AS elo, max(bin_end) AS ehi FROM hist GROUP BY feature),
cin AS (
  SELECT feature, CAST(least(floor((value - elo) * 20.0e0 / (ehi - elo)), 19) AS INTEGER) AS bin, count(*) AS nc
  FROM cur JOIN edges USING (feature) WHERE value >= elo AND value <= ehi GROUP BY 1, 2
),
bins AS (
  SELECT h.feature, h.bin, h.count AS n_base, coalesce(nc, 0) AS n_cur, h.density AS p_base,
    CAST(coalesce(nc, 0) AS DOUBLE) / sum(coalesce(nc, 0)) OVER (PARTITION BY h.feature) AS p_cur
  FROM hist h LEFT JOIN cin ON cin.feature = h.feature AND cin.bin = h.bin
),
psip AS (
  SELECT feature, sum((c / sc - b / sb) * ln((c / sc) / (b / sb))) AS psi FROM (
    SELECT feature, b, c, sum(b) OVER (PARTITION BY feature) AS sb, sum(c) OVER (PARTITION BY feature) AS sc FROM (
      SELECT feature, least(greatest(p_base, 1e-6), 1.0e0) AS b, least(greatest(p_cur, 1e-6), 1.0e0) AS c FROM bins))
  GROUP BY feature
)"""


def _pair(spark, sf):
    return baseline_long(spark, sf), current_long(spark, sf)


def _bins(spark, sf):
    base, cur = _pair(spark, sf)
    return D.counts_in_baseline_bins(cur, histogram(base))


def _priority_bins(spark, sf):
    """Order priority as a category: its mix in the first and second half of the order keys."""
    orders = table(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return orders.groupBy(F.lit("priority").alias("feature"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("bin")).agg(
        F.count_if(~late).alias("n_base"), F.count_if(late).alias("n_cur")
    )


_PRIORITY_SQL = """
pc AS (
  SELECT 'priority' AS feature, CAST(left(o_orderpriority, 1) AS INTEGER) AS bin,
    count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01 00:00:00') AS nb,
    count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01 00:00:00') AS nc FROM orders GROUP BY 1, 2
),
ex AS (SELECT *, nb * (CAST(sum(nc) OVER () AS DOUBLE) / sum(nb) OVER ()) AS e FROM pc)"""


def _feature_drift(spark, sf):
    base, cur = _pair(spark, sf)
    return D.feature_drift(feature_statistics(base), histogram(base), cur, baseline=base)


def _quality(spark, sf):
    base, cur = _pair(spark, sf)
    return D.dataset_quality(cur, feature_statistics(base), ["value", "k", "absent"])


def _score(spark, sf):
    base, cur = _pair(spark, sf)
    drift = D.psi_proportions(D.counts_in_baseline_bins(cur, histogram(base)))
    prediction = drift.where(F.col("feature") == "k").select("psi")
    plain = D.drift_score(drift).select(F.lit("plain").alias("variant"), "drift_score")
    with_p = D.drift_score(drift, prediction).select(F.lit("prediction").alias("variant"), "drift_score")
    weighted = D.drift_score(drift, prediction, {"value": 3.0}).select(F.lit("weighted").alias("variant"), "drift_score")
    return _rounded(plain.unionByName(with_p).unionByName(weighted), keep=("variant",))


def _bands(spark, sf):
    base, cur = _pair(spark, sf)
    return D.psi_samples(base, cur).select("feature", psi_band("psi").alias("band"))


def _monitored(spark, sf):
    """Rows of the monitored columns of a wide table, key features first."""
    names = D.monitored_features(["value", "k", *KEY_FEATURES[:3]], DriftConfig(top_features=4, excluded_features=("k",)))
    return current_long(spark, sf).where(F.col("feature").isin(names)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def _table_drift(spark, sf):
    return _rounded(D.table_drift(*_pair(spark, sf)))


def _dataset_drift(spark, sf):
    return D.dataset_drift(D.table_drift(*_pair(spark, sf)))


def _ecdf(spark, sf):
    steps = ordered.ecdf(current_long(spark, sf))
    return steps.select("feature", "value", "n", "before_n", F.round("cdf", 9).alias("cdf"))


def _ranks(spark, sf):
    long = current_long(spark, sf)
    return ordered.average_ranks(long, ["feature"], "value")


def written(df, name: str):
    """The rows of df as a Parquet table of the shared folder."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _user_pair(spark, sf):
    """Every user as a feature, with some dozens of values on each side."""
    events = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("feature"), "ts", "user_id", "value")
    late = F.col("ts") >= moment(SPLIT)
    moved = F.when(F.col("user_id") % 2 == 0, F.col("value") * 1.5).otherwise(F.col("value"))
    return events.where(~late).select("feature", "value"), events.where(late).select("feature", moved.alias("value"))


USER_SQL = """
ev AS (SELECT 'u' || user_id AS feature, ts, CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' AND user_id % 2 = 0 THEN value * 1.5e0 ELSE value END AS value FROM events),
base AS (SELECT feature, value FROM ev WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
cur AS (SELECT feature, value FROM ev WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')"""

def _sketch_distances(spark, sf):
    """Distances from stored sketches, held against those of all values."""
    base, cur = _pair(spark, sf)
    stored = [written(sketches.sketch_table(side), f"sketches-{i}") for i, side in enumerate((base, cur))]
    near = sketches.sketch_distances(*stored).withColumnsRenamed({"ks_statistic": "ks", "wasserstein": "area"})
    steps = D.two_sample_table(base, cur)
    exact = D.ks_two_sample(None, None, table=steps).join(D.wasserstein(None, None, table=steps), "feature")
    return near.join(exact, "feature").select(
        "feature", (F.abs(F.col("ks") - F.col("ks_statistic")) < 0.02).alias("ks_near"),
        (F.abs(F.col("area") - F.col("wasserstein")) <= 0.05 * F.col("wasserstein") + 0.5).alias("wasserstein_near"),
    )


def _daily_sketches(spark, sf):
    """One stored sketch per day and feature, merged over all days; its quartiles have about the ranks they should."""
    events = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "value", k_value().cast("double").alias("k"))
    long = to_long(events, ["value", "k"], keep=["day"])
    daily = written(sketches.sketch_table(long, ["day", "feature"]), "daily-sketches")
    days = daily.groupBy("feature").agg(F.count_distinct("day").alias("days"))
    whole = sketches.merged(daily).join(days, "feature")
    points = sketches.sketch_quantiles(whole, QUARTILES)
    ranks = long.join(F.broadcast(points), "feature").groupBy("feature").agg(  # one row a feature
        *[F.avg((F.col("value") <= F.col(c)).cast("int")).alias(f"{c}_upto") for c in QUARTILES],
        *[F.avg((F.col("value") < F.col(c)).cast("int")).alias(f"{c}_below") for c in QUARTILES],
    )
    near = [((F.col(f"{c}_below") <= q + 0.01) & (F.col(f"{c}_upto") >= q - 0.01)).alias(f"{c}_near") for c, q in QUARTILES.items()]
    return whole.join(ranks, "feature").select("feature", "n", "min", "max", "days", *near)


NORMAL_SQL = """
SELECT feature, round(d, 6) AS ks_statistic, round(CASE WHEN lam < 0.2 THEN 1.0e0 ELSE least(greatest(
    list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0e0 ELSE -2.0e0 END * exp(-2.0e0 * k * k * lam * lam))), 0.0e0), 1.0e0) END, 6) AS ks_pvalue
FROM (
  SELECT feature, max(greatest(CAST(upto AS DOUBLE) / n - f, f - CAST(upto - c AS DOUBLE) / n)) AS d, sqrt(any_value(n)) * d AS lam
  FROM (
    SELECT feature, c, upto, n, 0.5e0 * (1 + sign(z) * (1 - ((((1.061405429e0 * t - 1.453152027e0) * t + 1.421413741e0) * t - 0.284496736e0) * t + 0.254829592e0) * t * exp(-z * z))) AS f
    FROM (
      SELECT *, 1 / (1 + 0.3275911e0 * abs(z)) AS t FROM (
        SELECT feature, c, sum(c) OVER (PARTITION BY feature ORDER BY value) AS upto, sum(c) OVER (PARTITION BY feature) AS n,
          (value - mean) / greatest(std, 1e-6) / sqrt(2.0e0) AS z
        FROM (SELECT feature, value, count(*) AS c FROM cur WHERE value IS NOT NULL GROUP BY feature, value) JOIN st USING (feature))))
  GROUP BY feature)"""

_J = (LONG_SQL, JOINT_SQL)

QUERIES = {
    "g01_psi": (
        lambda spark, sf: _rounded(D.psi_samples(*_pair(spark, sf))),
        with_views(*_J, body="SELECT feature, round(psi, 6) AS psi FROM psi"),
    ),
    "g01_psi_no_drift": (
        lambda spark, sf: _rounded(D.psi_samples(baseline_long(spark, sf), current_long(spark, sf, drifted=False))),
        with_views(
            LONG_SQL.replace("CASE WHEN user_id % 2 = 0 THEN value * 1.5e0 ELSE value END", "value"), JOINT_SQL,
            body="SELECT feature, round(psi, 6) AS psi FROM psi",
        ),
    ),
    "g02_psi_proportions": (
        lambda spark, sf: _rounded(D.psi_proportions(_bins(spark, sf))),
        with_views(LONG_SQL, BASE_HIST_SQL, IN_BINS_SQL, body="SELECT feature, round(psi, 6) AS psi FROM psip"),
    ),
    "g03_ks_two_sample": (
        lambda spark, sf: _rounded(D.ks_two_sample(*_pair(spark, sf)), keep=("feature", "ks_method")),
        with_views(
            *_J, ECDF2_SQL, KS_SQL,
            body="SELECT feature, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue, ks_method FROM ks",
        ),
    ),
    "g03_ks_small_samples": (
        lambda spark, sf: _rounded(D.ks_two_sample(*_user_pair(spark, sf)), keep=("feature", "ks_method")),
        with_views(
            USER_SQL, JOINT_SQL, ECDF2_SQL, KS_SQL,
            body="SELECT feature, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue, ks_method FROM ks",
        ),
    ),
    "g03_sketch_distances": (
        _sketch_distances,
        with_views(LONG_SQL, body="SELECT feature, TRUE AS ks_near, TRUE AS wasserstein_near FROM base GROUP BY feature"),
    ),
    "f03_daily_sketches": (
        _daily_sketches,
        with_views(
            LONG_SQL,
            body="""SELECT feature, count(value) AS n, min(value) AS min, max(value) AS max, count(DISTINCT day) AS days, TRUE AS q25_near,
                      TRUE AS median_near, TRUE AS q75_near
                    FROM (SELECT 'value' AS feature, value, CAST(ts AS DATE) AS day FROM ev UNION ALL SELECT 'k', k, CAST(ts AS DATE) FROM ev)
                    GROUP BY feature""",
        ),
    ),
    "g04_ks_normal": (
        lambda spark, sf: _rounded(D.ks_normal(current_long(spark, sf), feature_statistics(baseline_long(spark, sf)))),
        with_views(LONG_SQL, STATS_SQL, body=NORMAL_SQL),
    ),
    "g05_chi_square": (
        lambda spark, sf: _rounded(D.chi_square(_priority_bins(spark, sf))),
        with_views(
            _PRIORITY_SQL,
            body="""SELECT feature, round(sum(CASE WHEN e > 0 THEN (nc - e) * (nc - e) / e END), 6) AS statistic,
                      count(*) FILTER (e > 0) - 1 AS degrees_of_freedom, false AS masked_mass FROM ex GROUP BY feature""",
        ),
    ),
    "g05_chi_square_pvalue": (
        lambda spark, sf: _rounded(D.chi_square_pvalues(_priority_bins(spark, sf))),
        with_views(
            _PRIORITY_SQL,
            """tested AS (SELECT feature, sum(CASE WHEN e > 0 THEN (nc - e) * (nc - e) / e END) / 2 AS x, (count(*) FILTER (e > 0) - 1) / 2 AS a FROM ex GROUP BY feature)""",
            body="""SELECT feature, round(2 * x, 6) AS statistic, round(least(1, greatest(0, 1 - coalesce((
                      SELECT sum(exp((a + n) * ln(x) - x - lgamma(a + n + 1))) FROM (SELECT unnest(range(400)) AS n)), 0))), 6) AS p_value,
                      false AS masked_mass FROM tested""",
        ),
    ),
    "g06_jensen_shannon": (
        lambda spark, sf: _rounded(D.jensen_shannon(_bins(spark, sf))),
        with_views(
            LONG_SQL, BASE_HIST_SQL, IN_BINS_SQL,
            body="""SELECT feature, round(sum(0.5e0 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))), 6) AS jsd FROM (
                      SELECT feature, (p_base + 1e-6) / sum(p_base + 1e-6) OVER w AS p, (p_cur + 1e-6) / sum(p_cur + 1e-6) OVER w AS q
                      FROM bins WINDOW w AS (PARTITION BY feature)) GROUP BY feature""",
        ),
    ),
    "g07_wasserstein": (
        lambda spark, sf: _rounded(D.wasserstein(*_pair(spark, sf))),
        with_views(*_J, ECDF2_SQL, body="SELECT feature, round(sum(abs(fb - fc) * coalesce(step, 0)), 6) AS wasserstein FROM steps GROUP BY feature"),
    ),
    "g08_mean_shift": (
        lambda spark, sf: _rounded(D.mean_shift(*_pair(spark, sf))),
        with_views(LONG_SQL, STATS_SQL, body="SELECT feature, round((current_mean - mean) / std, 6) AS mean_shift FROM st JOIN cm USING (feature)"),
    ),
    "g08_mean_shift_raw": (
        lambda spark, sf: _rounded(D.mean_shift(*_pair(spark, sf), normalize=False)),
        with_views(LONG_SQL, STATS_SQL, body="SELECT feature, round(current_mean - mean, 6) AS mean_shift FROM st JOIN cm USING (feature)"),
    ),
    "g09_outliers": (
        lambda spark, sf: _rounded(D.outliers(current_long(spark, sf), feature_statistics(baseline_long(spark, sf)), 2.0)),
        with_views(
            LONG_SQL, STATS_SQL,
            body="""SELECT feature, count(*) FILTER (value < mean - 2 * std OR value > mean + 2 * std) AS outlier_count,
                      round(CAST(count(*) FILTER (value < mean - 2 * std OR value > mean + 2 * std) AS DOUBLE) / count(value) * 100, 6) AS outlier_pct,
                      round(any_value(mean - 2 * std), 6) AS lower_bound, round(any_value(mean + 2 * std), 6) AS upper_bound
                    FROM cur JOIN st USING (feature) GROUP BY feature""",
        ),
    ),
    "g10_feature_quality": (
        lambda spark, sf: _rounded(D.feature_quality(current_long(spark, sf), feature_statistics(baseline_long(spark, sf)))),
        with_views(
            LONG_SQL, STATS_SQL,
            body="""SELECT feature, count(*) FILTER (value IS NULL) AS missing_count,
                      round(CAST(count(*) FILTER (value IS NULL) AS DOUBLE) / count(*) * 100, 6) AS missing_pct,
                      count(*) FILTER (value < min OR value > max) AS out_of_range_count,
                      round(CAST(count(*) FILTER (value < min OR value > max) AS DOUBLE) / count(value) * 100, 6) AS out_of_range_pct
                    FROM cur JOIN st USING (feature) GROUP BY feature""",
        ),
    ),
    "g11_drift_score": (
        _score,
        with_views(
            LONG_SQL, BASE_HIST_SQL, IN_BINS_SQL,
            body="""SELECT 'plain' AS variant, round(1 - exp(-avg(psi)), 6) AS drift_score FROM psip
                    UNION ALL SELECT 'prediction', round(1 - exp(-(sum(psi) + 2 * sum(psi) FILTER (feature = 'k')) / (count(*) + 1)), 6) FROM psip
                    UNION ALL SELECT 'weighted', round(1 - exp(-sum(psi * CASE feature WHEN 'value' THEN 3 ELSE 1 END) / 4), 6) FROM psip""",
        ),
    ),
    "g12_monitored_features": (
        _monitored,
        with_views(LONG_SQL, body="SELECT feature, count(*) AS n FROM cur WHERE feature = 'value' GROUP BY feature"),
    ),
    "g14_feature_drift": (
        lambda spark, sf: _rounded(_feature_drift(spark, sf)),
        with_views(
            *_J, ECDF2_SQL, KS_SQL, BASE_HIST_SQL, IN_BINS_SQL, STATS_SQL,
            body="""SELECT feature, round(p.psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue,
                      p.psi > 0.2 OR ks_pvalue < 0.05 AS drift_detected, round(mean, 6) AS baseline_mean,
                      round(current_mean, 6) AS current_mean, round(current_mean - mean, 6) AS mean_shift
                    FROM psip p JOIN ks USING (feature) JOIN st USING (feature) JOIN cm USING (feature)""",
        ),
    ),
    "g15_prediction_drift": (
        lambda spark, sf: _rounded(
            D.prediction_drift(
                feature_statistics(baseline_long(spark, sf).where("feature = 'k'")),
                histogram(baseline_long(spark, sf).where("feature = 'k'")),
                current_long(spark, sf).where("feature = 'k'"),
            )
        ),
        with_views(
            LONG_SQL, BASE_HIST_SQL, IN_BINS_SQL, STATS_SQL,
            body="""SELECT round(psi, 6) AS psi, round(current_mean - mean, 6) AS mean_shift, round(mean, 6) AS baseline_mean,
                      round(current_mean, 6) AS current_mean, psi > 0.2 AS drift_detected
                    FROM psip JOIN st USING (feature) JOIN cm USING (feature) WHERE feature = 'k'""",
        ),
    ),
    "g16_dataset_quality": (
        lambda spark, sf: _rounded(_quality(spark, sf)),
        with_views(
            LONG_SQL, STATS_SQL,
            body="""SELECT round(m, 6) AS missing_values_pct, round(o, 6) AS out_of_range_pct, CAST(1 AS BIGINT) AS null_features_count,
                      m > 5 OR o > 1 AS issues_detected FROM (
                        SELECT CAST(count(*) FILTER (value IS NULL) AS DOUBLE) / count(*) * 100 AS m,
                          CAST(count(*) FILTER (value < min OR value > max) AS DOUBLE) / count(*) * 100 AS o
                        FROM cur JOIN st USING (feature))""",
        ),
    ),
    "g20_psi_band": (
        _bands,
        with_views(*_J, body="SELECT feature, CASE WHEN psi < 0.1 THEN 'none' WHEN psi <= 0.2 THEN 'minor' ELSE 'significant' END AS band FROM psi"),
    ),
    "g23_table_drift": (
        _table_drift,
        with_views(
            *_J, ECDF2_SQL, KS_SQL,
            body="""SELECT feature, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue,
                      psi > 0.2 OR ks_pvalue < 0.05 AS drift_detected FROM psi JOIN ks USING (feature)""",
        ),
    ),
    "g23_dataset_drift": (
        _dataset_drift,
        with_views(
            *_J, ECDF2_SQL, KS_SQL,
            body="""SELECT n > 0 AS drift_detected, CAST(n AS DOUBLE) / t AS drift_share, t AS number_of_columns, n AS number_of_drifted_columns
                    FROM (SELECT count(*) AS t, count(*) FILTER (psi > 0.2 OR ks_pvalue < 0.05) AS n FROM psi JOIN ks USING (feature))""",
        ),
    ),
    "w03_ecdf": (
        _ecdf,
        with_views(
            LONG_SQL,
            body="""SELECT feature, value, n, CAST(c - n AS BIGINT) AS before_n, round(CAST(c AS DOUBLE) / t, 9) AS cdf FROM (
                      SELECT feature, value, n, sum(n) OVER (PARTITION BY feature ORDER BY value) AS c, sum(n) OVER (PARTITION BY feature) AS t
                      FROM (SELECT feature, value, count(*) AS n FROM cur GROUP BY feature, value))""",
        ),
    ),
    "w04_average_rank": (
        _ranks,
        with_views(
            LONG_SQL,
            body="""SELECT feature, value, n AS ties, CAST(c - n AS DOUBLE) + (n + 1) / 2.0e0 AS avg_rank FROM (
                      SELECT feature, value, n, sum(n) OVER (PARTITION BY feature ORDER BY value) AS c
                      FROM (SELECT feature, value, count(*) AS n FROM cur GROUP BY feature, value))""",
        ),
    ),
}
