"""Windowed log statistics: the batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.distribution import histogram
from ..session import scratch_folder
from ..sources.logs import with_partitions
from ..streaming import windows
from ..streaming.ledger import Ledger, ledger_stream
from .aggregates import _rounded
from .drift import BASE_HIST_SQL
from .monitoring import daily_values
from .views import LOGS_SQL, LONG_SQL, baseline_long, logs, moment, with_views


def _sliding(spark, sf):
    hist = histogram(baseline_long(spark, sf))
    hourly = windows.hourly_bin_counts(daily_values(spark, sf), hist)
    return _rounded(windows.window_psi(windows.sliding_from_hourly(hourly, 24), hist))


def _sliding_psi(spark, sf):
    """The form that streams use, over the table."""
    hist = histogram(baseline_long(spark, sf))
    return _rounded(windows.sliding_psi(daily_values(spark, sf), hist))


_SLIDING_SQL = """
dv AS (
  SELECT ts, 'value' AS feature, CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' AND user_id % 2 = 0 THEN value * 1.5e0 ELSE value END AS value FROM ev
  UNION ALL SELECT ts, 'k', k FROM ev
),
edges AS (SELECT feature, min(bin_start) AS elo, max(bin_end) AS ehi FROM hist GROUP BY feature),
hb AS (
  SELECT date_trunc('hour', ts) AS h, feature, CAST(least(floor((value - elo) * 20.0e0 / (ehi - elo)), 19) AS INTEGER) AS bin, count(*) AS nc
  FROM dv JOIN edges USING (feature) WHERE value >= elo AND value <= ehi GROUP BY 1, 2, 3
),
wb AS (SELECT h - back * INTERVAL 1 HOUR AS w, feature, bin, sum(nc) AS nc FROM hb, (SELECT unnest(range(24)) AS back) GROUP BY 1, 2, 3),
wt AS (SELECT w, feature, sum(nc) AS t FROM wb GROUP BY 1, 2),
grid AS (
  SELECT wt.w, wt.feature, least(greatest(hist.density, 1e-6), 1.0e0) AS b, least(greatest(CAST(coalesce(nc, 0) AS DOUBLE) / t, 1e-6), 1.0e0) AS c
  FROM wt JOIN hist ON hist.feature = wt.feature LEFT JOIN wb ON wb.w = wt.w AND wb.feature = wt.feature AND wb.bin = hist.bin
)"""

_SLIDING_PSI_SQL = with_views(
    LONG_SQL, BASE_HIST_SQL, _SLIDING_SQL,
    body="""SELECT w AS window_start, w + INTERVAL 24 HOUR AS window_end, feature, round(sum((c / sc - b / sb) * ln((c / sc) / (b / sb))), 6) AS psi
            FROM (SELECT *, sum(b) OVER p AS sb, sum(c) OVER p AS sc FROM grid WINDOW p AS (PARTITION BY w, feature)) GROUP BY 1, 2, 3""",
)

_COUNTERS_SQL = """
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS window_end,
  prediction, count(*) AS n, round(avg(latency_ms), 6) AS avg_latency_ms, max(latency_ms) AS max_latency_ms
FROM logs GROUP BY 1, 2, 3"""

def _streamed(spark, sf, write=None):
    """The log as a stream of files through the ledger, run to its end and then once more from the start."""
    rows = logs(spark, sf)
    source = scratch_folder(spark, "arriving")
    rows.repartition(6, "inference_id").write.parquet(source)
    folder = scratch_folder(spark, "ledger")
    ledger = Ledger(spark, folder, **({"write": write} if write else {}))
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    # The second run has lost its checkpoint and hands over all batches again.
    for run in ("first", "again"):
        query = ledger_stream(arriving, ledger, f"{folder}/_{run}", once=True).start()
        query.awaitTermination()
    return ledger, rows.schema


def _log_sink(spark, sf):
    """Rows by hour of the streamed log, whose batches were all handed over twice."""
    ledger, schema = _streamed(spark, sf)
    return ledger.log(schema).groupBy("year", "month", "day", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("inference_id").alias("ids")
    )


def _failing_sink(spark, sf):
    """Every second batch cannot be written: its rows are dead letters, and none is lost or doubled."""
    def broken(batch, path):
        if int(path.split("/batch=")[1].split("/")[0]) % 2:
            raise OSError("no space left")
        batch.write.parquet(path)

    ledger, schema = _streamed(spark, sf, broken)
    stored, dead = ledger.log(schema), ledger.dead_letters(schema)
    known = ledger.manifest().agg(F.sum("n").alias("n")).scalar()
    every = stored.select("prediction", "inference_id", F.lit(None).cast("string").alias("error")).unionByName(
        dead.select("prediction", "inference_id", "error")
    )
    return every.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("inference_id").alias("ids"),
        F.min("error").alias("reason"), F.max(known).alias("in_manifest"),
    )


QUERIES = {
    "k01_log_sink": (
        _log_sink,
        with_views(
            LOGS_SQL,
            body="""SELECT strftime(timestamp, '%Y') AS year, strftime(timestamp, '%m') AS month, strftime(timestamp, '%d') AS day,
                      strftime(timestamp, '%H') AS hour, count(*) AS n, count(DISTINCT inference_id) AS ids FROM logs GROUP BY 1, 2, 3, 4""",
        ),
    ),
    "k02_dead_letters": (
        _failing_sink,
        with_views(
            LOGS_SQL,
            body="""SELECT prediction, count(*) AS n, count(DISTINCT inference_id) AS ids, 'no space left' AS reason,
                      (SELECT count(*) FROM logs) AS in_manifest FROM logs GROUP BY prediction""",
        ),
    ),
    "a06_log_partitions": (
        lambda spark, sf: with_partitions(logs(spark, sf)).groupBy("year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("n")),
        with_views(
            LOGS_SQL,
            body="""SELECT strftime(timestamp, '%Y') AS year, strftime(timestamp, '%m') AS month, strftime(timestamp, '%d') AS day,
                      strftime(timestamp, '%H') AS hour, count(*) AS n FROM logs GROUP BY 1, 2, 3, 4""",
        ),
    ),
    "k03_sliding_drift": (_sliding, _SLIDING_PSI_SQL),
    "k03_sliding_psi": (
        _sliding_psi, f"SELECT *, psi > 0.2 AS drift_detected FROM ({_SLIDING_PSI_SQL})"
    ),
    "k04_prediction_counters": (
        lambda spark, sf: _rounded(windows.prediction_counters(logs(spark, sf)), keep=("prediction",)),
        with_views(LOGS_SQL, body=_COUNTERS_SQL),
    ),
    "k05_retained_series": (
        lambda spark, sf: _rounded(
            windows.retained(windows.prediction_counters(logs(spark, sf)), moment("2024-01-30 23:00:00")), keep=("prediction",)
        ),
        with_views(LOGS_SQL, body=f"SELECT * FROM ({_COUNTERS_SQL}) WHERE window_start >= TIMESTAMP '2024-01-29 23:00:00'"),
    ),
}
