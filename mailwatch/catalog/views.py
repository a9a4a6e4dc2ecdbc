"""Mail, log, score and history views over the given tables, in Spark and in SQL.

Both forms compute the same rows; the SQL forms are common table expressions.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

SPLIT = "2024-01-16 00:00:00"
JOB_TIME = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def moment(text: str) -> Column:
    """A wall-clock instant without zone, like the timestamps of the tables."""
    return F.lit(text).cast("timestamp_ntz")


# --- emails ---------------------------------------------------------------------------


def mail_columns(doc: str = "doc_id") -> dict[str, Column]:
    d = F.col(doc)
    user = F.concat(F.lit("user"), F.when(d % 2 == 0, "").otherwise((d % 37).cast("string")))
    at = F.when(d % 41 == 0, "").otherwise("@")
    address = F.concat(user, at, F.col("source"), F.lit(".example"))
    return {
        "email_id": d.cast("string"),
        "subject": F.left("text", F.lit(60)),
        "body_text": F.col("text"),
        "sender_email": address,
        "sender_domain": F.when(d % 41 == 0, "").otherwise(F.concat("source", F.lit(".example"))),
        "x_mailer": F.when(d % 5 >= 3, "client"),
        "received_hop_count": F.when(d % 17 != 0, (d % 6).cast("int")),
        "date": F.when(d % 23 != 0, moment("2024-01-01 00:00:00") + d * F.lit(timedelta(minutes=37))),
        "filename": F.concat(F.lit("m"), d.cast("string")),
    }


def emails(spark: SparkSession, sf: str, html: bool = True, labels: bool = True) -> DataFrame:
    """documents as mails; ``html`` and ``labels`` join the other tables only when needed."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")
    df = docs.select("doc_id", *[c.alias(n) for n, c in mail_columns().items()])
    if html:
        pages = table(spark, sf, "pages")
        n_pages = pages.agg(F.count(F.lit(1))).scalar()
        # Mails without a page get distinct keys that match nothing: NULLs would share one partition.
        page = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % n_pages).otherwise(-1 - F.col("doc_id"))
        df = df.withColumn("page_id", page).join(
            pages.select("page_id", F.col("html").alias("body_html")), "page_id", "left"
        )
    else:
        df = df.withColumn("body_html", F.lit(None).cast("string"))
    if labels:
        spam = (F.col("quality") == 0) | (F.col("toxic") == 1)
        labelled = table(spark, sf, "labels").select("doc_id", F.when(spam, "spam").otherwise("ham").alias("label"))
        df = df.join(labelled, "doc_id", "left")
    else:
        df = df.withColumn("label", F.lit(None).cast("string"))
    return df.drop("page_id")


EMAILS_SQL = """
emails AS (
  SELECT d.doc_id,
    CAST(d.doc_id AS VARCHAR) AS email_id,
    substr(d.text, 1, 60) AS subject,
    d.text AS body_text,
    'user' || CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE CAST(d.doc_id % 37 AS VARCHAR) END
      || CASE WHEN d.doc_id % 41 = 0 THEN '' ELSE '@' END || d.source || '.example' AS sender_email,
    CASE WHEN d.doc_id % 41 = 0 THEN '' ELSE d.source || '.example' END AS sender_domain,
    CASE WHEN d.doc_id % 5 >= 3 THEN 'client' END AS x_mailer,
    CASE WHEN d.doc_id % 17 <> 0 THEN CAST(d.doc_id % 6 AS INTEGER) END AS received_hop_count,
    CASE WHEN d.doc_id % 23 <> 0
      THEN TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 37 MINUTE END AS date,
    'm' || CAST(d.doc_id AS VARCHAR) AS filename,
    p.html AS body_html,
    CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 'spam' WHEN l.doc_id IS NOT NULL THEN 'ham' END AS label
  FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN pages p ON d.doc_id % 3 = 0 AND p.page_id = d.doc_id % (SELECT count(*) FROM pages)
)"""


def content_emails(spark: SparkSession, sf: str) -> DataFrame:
    """Mails whose id is the hash of their text, so identical mails share it."""
    return emails(spark, sf, html=False).withColumn("email_id", F.substring(F.sha2("body_text", 256), 1, 16))


CONTENT_EMAILS_SQL = """
content_emails AS (
  SELECT * REPLACE (substr(sha256(body_text), 1, 16) AS email_id) FROM emails
)"""


# --- inference log --------------------------------------------------------------------


def k_value() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """events as an inference log."""
    k = k_value()
    features = F.to_json(F.struct(F.col("value"), k.cast("double").alias("k")))
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("inference_id"),
        F.col("ts").alias("timestamp"),
        F.when(k >= 70, "spam").otherwise("ham").alias("prediction"),
        (k.cast("double") / 100).alias("spam_probability"),
        F.col("value").alias("latency_ms"),
        F.col("event_type").alias("status"),
        F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string")).alias("sender_domain"),
        "user_id",
        features.alias("features_json"),
    )


LOGS_SQL = """
logs AS (
  SELECT CAST(event_id AS VARCHAR) AS inference_id, ts AS timestamp, k,
    CASE WHEN k >= 70 THEN 'spam' ELSE 'ham' END AS prediction,
    CAST(k AS DOUBLE) / 100 AS spam_probability, value AS latency_ms, value, event_type AS status,
    'd' || CAST(user_id % 20 AS VARCHAR) AS sender_domain, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def baseline_long(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, value) of the first half month."""
    return _long(table(spark, sf, "events").where(F.col("ts") < moment(SPLIT)))


def current_long(spark: SparkSession, sf: str, drifted: bool = True) -> DataFrame:
    """(feature, value) of the second half month; drifted: value × 1.5 for even users."""
    rows = table(spark, sf, "events").where(F.col("ts") >= moment(SPLIT))
    if drifted:
        rows = rows.withColumn("value", F.when(F.col("user_id") % 2 == 0, F.col("value") * 1.5).otherwise(F.col("value")))
    return _long(rows)


def _long(events: DataFrame) -> DataFrame:
    cells = F.array(
        F.struct(F.lit("value").alias("feature"), F.col("value").alias("value")),
        F.struct(F.lit("k").alias("feature"), k_value().cast("double").alias("value")),
    )
    return events.select(F.inline(cells))


LONG_SQL = """
ev AS (
  SELECT ts, user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
),
base AS (
  SELECT 'value' AS feature, value FROM ev WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
  UNION ALL SELECT 'k', k FROM ev WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
),
cur AS (
  SELECT 'value' AS feature, CASE WHEN user_id % 2 = 0 THEN value * 1.5e0 ELSE value END AS value
    FROM ev WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
  UNION ALL SELECT 'k', k FROM ev WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
)"""


# --- scored rows ----------------------------------------------------------------------


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with two scores; ties on purpose."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    a = (F.col("n_chars") % 101).cast("double") / 100
    b = (F.col("doc_id") * 7 % 101).cast("double") / 100
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        "lang",
        F.col("quality").alias("label"),
        a.alias("score"),
        b.alias("score_b"),
        (a >= 0.5).cast("int").alias("prediction"),
        (b >= 0.5).cast("int").alias("prediction_b"),
    )


SCORED_SQL = """
scored AS (
  SELECT d.doc_id, d.lang, l.quality AS label,
    CAST(d.n_chars % 101 AS DOUBLE) / 100 AS score, CAST(d.doc_id * 7 % 101 AS DOUBLE) / 100 AS score_b,
    CAST(d.n_chars % 101 >= 50 AS INTEGER) AS prediction, CAST(d.doc_id * 7 % 101 >= 50 AS INTEGER) AS prediction_b
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a scored table."""
    p = (F.col("n_chars") % 101).cast("double") / 100
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("email_id"),
        F.left("text", F.lit(120)).alias("subject"),
        F.col("text").alias("body_text"),
        p.alias("spam_probability"),
        (p >= 0.7).cast("int").alias("spam_label"),
    )


PREDICTIONS_SQL = """
predictions AS (
  SELECT CAST(doc_id AS VARCHAR) AS email_id, substr(text, 1, 120) AS subject, text AS body_text,
    CAST(n_chars % 101 AS DOUBLE) / 100 AS spam_probability,
    CAST(n_chars % 101 >= 70 AS INTEGER) AS spam_label
  FROM documents
)"""


# --- feature history ------------------------------------------------------------------


def feature_history(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and day: events and mean value, stamped at the end of the day."""
    day = F.date_trunc("day", "ts")
    return (
        table(spark, sf, "events")
        .groupBy("user_id", day.alias("d"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("value"), 6).alias("mean_value"))
        .select("user_id", "n_events", "mean_value", (F.col("d").cast("timestamp_ntz") + F.lit(timedelta(days=1))).alias("event_timestamp"))
    )


FEATURE_HISTORY_SQL = """
history AS (
  SELECT user_id, count(*) AS n_events, round(avg(value), 6) AS mean_value,
    date_trunc('day', ts) + INTERVAL 1 DAY AS event_timestamp
  FROM events GROUP BY user_id, date_trunc('day', ts)
)"""


def with_views(*parts: str, body: str) -> str:
    kind = "WITH RECURSIVE " if any("lattice AS" in p for p in parts) else "WITH "
    return kind + ",".join(p.strip() for p in parts) + "\n" + body.strip()
