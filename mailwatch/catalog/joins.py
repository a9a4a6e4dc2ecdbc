"""Joins, latest-per-key, set operations, predicates and paging."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..config import TfidfConfig
from ..functions.features import PROFILES, SENDER, feature_rows
from ..functions.labels import encode_label
from ..operators import joins, latest, predicates, ranking, tfidf
from ..operators.aggregates import sender_features
from ..plans.feature_store import Entity, FeatureService, FeatureStore, FeatureView
from ..plans.training import training_table
from ..session import scratch_folder
from ..sources.snapshots import Snapshot
from .features import SQL_TRAIN
from .textual import _sql as tfidf_sql
from .views import (
    CONTENT_EMAILS_SQL, EMAILS_SQL, FEATURE_HISTORY_SQL, JOB_TIME, LOGS_SQL, PREDICTIONS_SQL, content_emails, emails,
    feature_history, logs, moment, predictions, table, with_views,
)

TTL = timedelta(days=3)

SENDERS_SQL = """
senders AS (
  SELECT sender_domain, count(*) AS email_count, count(*) FILTER (label = 'spam') AS spam_count,
    count(*) FILTER (label = 'ham') AS ham_count,
    CAST(count(*) FILTER (label = 'spam') AS DOUBLE) / count(*) AS spam_ratio
  FROM emails WHERE sender_domain IS NOT NULL GROUP BY sender_domain
)"""

_FEATURES = ["url_count", "word_count", "uppercase_ratio", "hour_of_day"]
_FEATURES_SQL = ", ".join(f"{SQL_TRAIN[f]} AS {f}" for f in _FEATURES)


def _entities(spark, sf):
    return predicates.entity_table(emails(spark, sf, html=False), moment(JOB_TIME))


ENTITIES_SQL = f"""
entities AS (
  SELECT email_id, TIMESTAMP '{JOB_TIME}' AS event_timestamp,
    CASE label WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 END AS label, sender_domain
  FROM emails WHERE label IN ('ham', 'spam')
)"""


def _features(spark, sf):
    rows = feature_rows(emails(spark, sf, html=False), moment(JOB_TIME))
    return rows.select("email_id", "label", *_FEATURES, "event_timestamp")


FEATURE_TABLE_SQL = f"""
feats AS (
  SELECT email_id, label, {_FEATURES_SQL}, TIMESTAMP '{JOB_TIME}' AS event_timestamp FROM emails
)"""


def _scalars_with_tfidf(spark, sf):
    """Deduplicated mails: scalars joined with their TF-IDF term count."""
    mails = latest.dedupe_content(content_emails(spark, sf))
    model = tfidf.fit(table(spark, sf, "documents"), "text", TfidfConfig())
    weights = model.transform_long(mails, "email_id", "body_text").groupBy("email_id").agg(
        F.count(F.lit(1)).cast("double").alias("tfidf_terms"), F.round(F.sum("weight"), 6).alias("tfidf_sum")
    )
    rows = feature_rows(mails, moment(JOB_TIME)).select("email_id", "word_count", "char_count")
    return rows.join(weights, "email_id", "left")


_E1_SQL = tfidf_sql(
    """SELECT substr(sha256(text), 1, 16) AS email_id, any_value(word_count) AS word_count, any_value(char_count) AS char_count,
         any_value(tfidf_terms) AS tfidf_terms, any_value(tfidf_sum) AS tfidf_sum
       FROM (SELECT doc_id, text, {wc} AS word_count, {cc} AS char_count FROM (SELECT *, text AS body_text FROM documents))
       LEFT JOIN (SELECT doc_id, CAST(count(*) AS DOUBLE) AS tfidf_terms, round(sum(weight), 6) AS tfidf_sum FROM weights GROUP BY doc_id)
       USING (doc_id) GROUP BY 1""".replace("{wc}", SQL_TRAIN["word_count"]).replace("{cc}", SQL_TRAIN["char_count"])
)


def _entity_features(spark, sf):
    return joins.left_join_suffixed(_entities(spark, sf), _features(spark, sf), "email_id", "_feat")


def _entity_senders(spark, sf):
    return joins.join_sender_features(
        _entities(spark, sf), sender_features(emails(spark, sf, html=False), moment(JOB_TIME))
    )


def _known_senders(spark, sf):
    """Sender features of the named domains; mails without a domain have no features."""
    return sender_features(emails(spark, sf, html=False)).where(F.col("sender_domain") != "")


def _lookup(profile: str, **overrides):
    defaults = {**PROFILES[profile].sender, **overrides}

    def run(spark, sf):
        keys = emails(spark, sf, html=False, labels=False).select("email_id", "sender_domain")
        return joins.lookup_with_defaults(keys, _known_senders(spark, sf), ["sender_domain"], defaults)

    cols = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), {float(v)!r}e0) AS {c}" for c, v in defaults.items())
    sql = with_views(
        EMAILS_SQL, SENDERS_SQL,
        body=f"""SELECT e.email_id, e.sender_domain, {cols} FROM emails e
                 LEFT JOIN (SELECT * FROM senders WHERE sender_domain <> '') s USING (sender_domain)""",
    )
    return run, sql


def _defaults_by_profile(spark, sf):
    keys = emails(spark, sf, html=False, labels=False).select("email_id", "sender_domain")
    known = _known_senders(spark, sf)
    out = keys
    for p, profile in PROFILES.items():
        one = joins.lookup_with_defaults(keys, known, ["sender_domain"], profile.sender)
        out = out.join(one.select("email_id", *[F.col(c).alias(f"{c}_{p}") for c in SENDER]), "email_id")
    return out


def _defaults_by_profile_sql() -> str:
    cols = ", ".join(
        f"coalesce(CAST(s.{c} AS DOUBLE), {float(v)!r}e0) AS {c}_{p}"
        for p, profile in PROFILES.items() for c, v in profile.sender.items()
    )
    return with_views(
        EMAILS_SQL, SENDERS_SQL,
        body=f"""SELECT e.email_id, e.sender_domain, {cols} FROM emails e
                 LEFT JOIN (SELECT * FROM senders WHERE sender_domain <> '') s USING (sender_domain)""",
    )


def _many_keys(spark, sf):
    """Features of every domain written on a page or in a source name, known or not."""
    sources = table(spark, sf, "documents").select(F.concat("source", F.lit(".example")).alias("sender_domain"))
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("sender_domain"))
    keys = joins.union_parts([sources, hosts]).distinct()
    senders = sender_features(emails(spark, sf, html=False))
    return joins.lookup_with_defaults(keys, senders, ["sender_domain"], PROFILES["serve"].sender)


def _point_in_time(spark, sf):
    entities = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("event_timestamp"))
    return joins.point_in_time_join(
        entities, feature_history(spark, sf), ["user_id"], TTL, ["n_events", "mean_value"]
    ).withColumn("n_events", F.col("n_events").cast("double"))


_PIT_BODY = """
SELECT event_id, e.user_id, e.ts AS event_timestamp,
  CASE WHEN h.event_timestamp >= e.ts - INTERVAL 3 DAY THEN CAST(h.n_events AS DOUBLE) END AS n_events,
  CASE WHEN h.event_timestamp >= e.ts - INTERVAL 3 DAY THEN h.mean_value END AS mean_value
FROM events e ASOF LEFT JOIN history h ON e.user_id = h.user_id AND e.ts >= h.event_timestamp"""


def _user_store(spark, sf) -> FeatureStore:
    """Two views of one source and a service over them."""
    user = Entity("user", ("user_id",))
    views = (
        FeatureView("activity", user, ("n_events",), TTL, "user_history"),
        FeatureView("level", user, ("mean_value",), TTL, "user_history"),
    )
    return FeatureStore({"user_history": feature_history(spark, sf)}, views, (FeatureService("users", ("level", "activity")),))


def _event_entities(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("event_timestamp"))


def _references(spark, sf):
    return _user_store(spark, sf).get(_event_entities(spark, sf), references=["level:mean_value"])


def _view_statistics(spark, sf):
    return _user_store(spark, sf).statistics(spark).select("view", "features", "ttl_days", F.col("rows").alias("source_rows"))


def _service(spark, sf):
    """The service retrieved as of each event."""
    return _user_store(spark, sf).get(_event_entities(spark, sf), "users").withColumn("n_events", F.col("n_events").cast("double"))


def _materialized(spark, sf):
    return latest.materialize(
        feature_history(spark, sf), ["user_id"], moment("2024-01-05 00:00:00"), moment("2024-01-20 00:00:00")
    )


def _materialized_incremental(spark, sf):
    history = feature_history(spark, sf)
    snapshot = latest.materialize(history, ["user_id"], moment("2024-01-01 00:00:00"), moment("2024-01-15 00:00:00"))
    return latest.materialize_incremental(
        snapshot, history, ["user_id"], moment("2024-01-15 00:00:00"), moment("2024-01-31 00:00:00")
    )


def _stored_upserts(spark, sf):
    """The same through a stored snapshot: two runs, each of which writes the buckets that its rows touch."""
    history = feature_history(spark, sf)
    kept = Snapshot(spark, scratch_folder(spark, "snapshot"), ("user_id",), buckets=16)
    for end in ("2024-01-15 00:00:00", "2024-01-31 00:00:00"):
        kept.upsert(history, moment(end))
    return kept.read(history.schema)


def _latest_sql(condition: str) -> str:
    return with_views(
        FEATURE_HISTORY_SQL,
        body=f"""SELECT user_id, n_events, mean_value, event_timestamp FROM (
                   SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn
                   FROM history WHERE {condition}) WHERE rn = 1""",
    )


def _normalised(spark, sf):
    """Log latencies in units of the status group's spread: small statistics joined to every row."""
    rows = logs(spark, sf).select("inference_id", "status", "latency_ms")
    stats = rows.groupBy("status").agg(F.avg("latency_ms").alias("m"), F.stddev_pop("latency_ms").alias("s"))
    z = (F.col("latency_ms") - F.col("m")) / F.col("s")
    return rows.join(F.broadcast(stats), "status").select(  # one row per status code
        "inference_id", F.round(z, 6).alias("z")
    )


def _paged(spark, sf):
    return ranking.page(predictions(spark, sf).select("email_id", "spam_probability"), [F.col("spam_probability").desc(), "email_id"], 20, 50)[0]


def _page_info(spark, sf):
    return ranking.page(predictions(spark, sf), ["email_id"], 20, 50)[1]


def _result_rows(spark, sf):
    return predicates.result_rows(predictions(spark, sf))


def _labels_encoded(spark, sf):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.upper("label")).otherwise(F.col("label"))
    df = emails(spark, sf, html=False).withColumn("label", mixed)
    return df.select(
        "email_id",
        encode_label("label").cast("double").alias("strict"),
        encode_label("label", ignore_case=True).cast("double").alias("relaxed"),
    )


_MIXED = "CASE WHEN doc_id % 3 = 0 THEN upper(label) ELSE label END"

def _numeric_columns(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", *predicates.feature_columns(rows, exclude=["o_orderkey"]))


def _default_columns(spark, sf):
    """Mail columns where present, defaults where not."""
    rows = predicates.with_default(table(spark, sf, "documents"), "event_timestamp", moment(JOB_TIME))
    return rows.select(
        "doc_id",
        "event_timestamp",
        predicates.column_or(rows, "lang", F.lit("none")).alias("lang"),
        predicates.column_or(rows, "x_mailer", F.lit("none")).alias("x_mailer"),
    )


def _common(spark, sf):
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    return marks.select(*joins.common_columns(docs, marks)).join(docs.select("doc_id", "lang"), "doc_id")


QUERIES = {
    "e01_scalars_with_tfidf": (_scalars_with_tfidf, _E1_SQL),
    "e02_entity_features": (
        _entity_features,
        with_views(
            EMAILS_SQL, ENTITIES_SQL, FEATURE_TABLE_SQL,
            body=f"""SELECT e.*, f.label AS label_feat, {", ".join("f." + c for c in _FEATURES)}, f.event_timestamp AS event_timestamp_feat
                     FROM entities e LEFT JOIN feats f USING (email_id)""",
        ),
    ),
    "e03_entity_senders": (
        _entity_senders,
        with_views(
            EMAILS_SQL, ENTITIES_SQL, SENDERS_SQL,
            body=f"""SELECT e.*, email_count, spam_count, ham_count, spam_ratio, TIMESTAMP '{JOB_TIME}' AS event_timestamp_sender
                     FROM entities e LEFT JOIN senders s USING (sender_domain)""",
        ),
    ),
    "e04_lookup_with_defaults": _lookup("serve"),
    "e05_many_key_lookup": (
        _many_keys,
        with_views(
            EMAILS_SQL, SENDERS_SQL,
            """keys AS (SELECT source || '.example' AS sender_domain FROM documents
                 UNION SELECT regexp_extract(url, '//([^/]+)', 1) FROM pages)""",
            body="""SELECT k.sender_domain, coalesce(CAST(email_count AS DOUBLE), 122.0e0) AS email_count,
                      coalesce(CAST(spam_count AS DOUBLE), 18.0e0) AS spam_count,
                      coalesce(CAST(ham_count AS DOUBLE), 104.0e0) AS ham_count,
                      coalesce(spam_ratio, 0.15e0) AS spam_ratio
                    FROM keys k LEFT JOIN senders s USING (sender_domain)""",
        ),
    ),
    "c33_sender_defaults_by_profile": (_defaults_by_profile, _defaults_by_profile_sql()),
    "e06_point_in_time_join": (_point_in_time, with_views(FEATURE_HISTORY_SQL, body=_PIT_BODY)),
    "e07_dedupe_content": (
        lambda spark, sf: latest.dedupe_content(content_emails(spark, sf)).select("email_id", "filename", "subject"),
        with_views(
            EMAILS_SQL, CONTENT_EMAILS_SQL,
            body="""SELECT email_id, filename, subject FROM (
                      SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY filename) AS rn FROM content_emails)
                    WHERE rn = 1""",
        ),
    ),
    "e08_broadcast_statistics": (
        _normalised,
        with_views(
            LOGS_SQL,
            body="""SELECT inference_id, round((latency_ms - avg(latency_ms) OVER w) / stddev_pop(latency_ms) OVER w, 6) AS z
                    FROM logs WINDOW w AS (PARTITION BY status)""",
        ),
    ),
    "h01_entities": (_entities, with_views(EMAILS_SQL, ENTITIES_SQL, body="SELECT * FROM entities")),
    "h03_training_table": (
        lambda spark, sf: training_table(
            _entities(spark, sf), _features(spark, sf).drop("label", "event_timestamp"),
            sender_features(emails(spark, sf, html=False)),
        ),
        with_views(
            EMAILS_SQL, ENTITIES_SQL, FEATURE_TABLE_SQL, SENDERS_SQL,
            body=f"""SELECT e.*, {", ".join("f." + c for c in _FEATURES)}, email_count, spam_count, ham_count, spam_ratio
                     FROM entities e LEFT JOIN feats f USING (email_id) LEFT JOIN senders s USING (sender_domain)""",
        ),
    ),
    "j02_service_retrieval": (
        _service,
        with_views(FEATURE_HISTORY_SQL, body=_PIT_BODY),
    ),
    "j03_feature_references": (
        _references,
        with_views(FEATURE_HISTORY_SQL, body=f"SELECT event_id, user_id, event_timestamp, mean_value FROM ({_PIT_BODY})"),
    ),
    "f19_feature_view_statistics": (
        _view_statistics,
        with_views(
            FEATURE_HISTORY_SQL,
            body="""SELECT v AS view, CAST(1 AS INTEGER) AS features, CAST(3 AS INTEGER) AS ttl_days, n AS source_rows
                    FROM (SELECT unnest(['activity', 'level']) AS v), (SELECT count(*) AS n FROM history)""",
        ),
    ),
    "p04_common_columns": (_common, "SELECT doc_id, lang FROM labels JOIN documents USING (doc_id)"),
    "p05_required_columns": (
        lambda spark, sf: predicates.require_columns(table(spark, sf, "labels"), ["doc_id", "quality"]).select("doc_id", "quality"),
        "SELECT doc_id, quality FROM labels",
    ),
    "p08_default_timestamp": (
        lambda spark, sf: _default_columns(spark, sf).select("doc_id", "event_timestamp"),
        f"SELECT doc_id, TIMESTAMP '{JOB_TIME}' AS event_timestamp FROM documents",
    ),
    "p09_numeric_features": (_numeric_columns, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "p11_defaulted_columns": (
        lambda spark, sf: _default_columns(spark, sf).drop("event_timestamp"),
        "SELECT doc_id, lang, 'none' AS x_mailer FROM documents",
    ),
    "p01_union_parts": (
        lambda spark, sf: joins.union_parts(
            [
                table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
                table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")),
            ]
        ),
        "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
    ),
    "p02_predicted_spam": (
        lambda spark, sf: predicates.predicted(predictions(spark, sf), True).select("email_id", "spam_probability"),
        with_views(PREDICTIONS_SQL, body="SELECT email_id, spam_probability FROM predictions WHERE spam_label = 1"),
    ),
    "p03_drop_incomplete": (
        lambda spark, sf: predicates.drop_incomplete(emails(spark, sf, html=False)).select("email_id", "label"),
        with_views(EMAILS_SQL, body="SELECT email_id, label FROM emails WHERE email_id IS NOT NULL AND label IS NOT NULL"),
    ),
    "p06_invalid_labels": (
        lambda spark, sf: predicates.invalid_labels(table(spark, sf, "conversations").select(F.col("turn").alias("label"))),
        "SELECT count(*) FILTER (turn NOT IN (0, 1)) AS invalid_labels FROM conversations",
    ),
    "p07_label_encoding": (
        _labels_encoded,
        with_views(
            EMAILS_SQL,
            body=f"""SELECT email_id, CASE {_MIXED} WHEN 'ham' THEN 0.0e0 WHEN 'spam' THEN 1.0e0 END AS strict,
                       CASE lower({_MIXED}) WHEN 'ham' THEN 0.0e0 WHEN 'spam' THEN 1.0e0 END AS relaxed FROM emails""",
        ),
    ),
    "p10_result_rows": (
        _result_rows,
        with_views(
            PREDICTIONS_SQL,
            body="""SELECT email_id, left(subject, 100) AS subject, left(body_text, 200) AS body_preview,
                      round(spam_probability, 4) AS spam_probability,
                      CASE WHEN spam_label = 1 THEN 'spam' ELSE 'ham' END AS spam_label,
                      CASE WHEN spam_probability > 0.8 OR spam_probability < 0.2 THEN 'high'
                        WHEN spam_probability > 0.6 OR spam_probability < 0.4 THEN 'medium' ELSE 'low' END AS confidence
                    FROM predictions""",
        ),
    ),
    "s02_page": (
        _paged,
        with_views(
            PREDICTIONS_SQL,
            body="SELECT email_id, spam_probability FROM predictions ORDER BY spam_probability DESC, email_id LIMIT 50 OFFSET 20",
        ),
    ),
    "s02_page_info": (
        _page_info,
        with_views(
            PREDICTIONS_SQL,
            body="""SELECT count(*) AS total_records, CAST(least(greatest(count(*) - 20, 0), 50) AS BIGINT) AS returned_records,
                      70 < count(*) AS has_more FROM predictions""",
        ),
    ),
    "w01_materialize": (
        _materialized,
        _latest_sql("event_timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"),
    ),
    "w02_materialize_incremental": (
        _materialized_incremental,
        _latest_sql("event_timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"),
    ),
    "w02_stored_upserts": (
        _stored_upserts,
        _latest_sql("event_timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"),
    ),
}
