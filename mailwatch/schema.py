"""Fixed table schemas. Sources declare them; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


STR, LONG, INT, DBL, BOOL, TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

EMAILS = _struct(
    email_id=STR, filename=STR, label=STR, subject=STR, sender_raw=STR, sender_email=STR,
    sender_domain=STR, recipient=STR, date=TS, body_text=STR, body_html=STR, content_type=STR,
    x_mailer=STR, received_hop_count=INT, received_hops=T.ArrayType(STR), return_path=STR,
    message_id=STR, x_spam_status=STR, x_spam_score=STR,
)

SENDER_FEATURES = _struct(
    sender_domain=STR, email_count=LONG, spam_count=LONG, ham_count=LONG, spam_ratio=DBL,
    event_timestamp=TS,
)

INFERENCE_LOG = _struct(
    inference_id=STR, timestamp=TS, model_name=STR, model_version=STR, prediction=STR,
    spam_probability=DBL, latency_ms=DBL, api_version=STR, environment=STR, email_id=STR,
    sender_domain=STR, features_json=STR, metadata_json=STR,
)
LOG_PARTITIONS = ["year", "month", "day", "hour"]

ALERT_COLUMNS = [
    "rule_order", "severity", "feature", "message", "recommendation", "metric_name",
    "metric_value", "threshold",
]
