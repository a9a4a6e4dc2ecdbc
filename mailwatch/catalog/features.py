"""Scalar message features: one query per feature, the assembled rows, and the profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, features, structure
from ..functions.text import SPAM_PHRASES
from .views import EMAILS_SQL, JOB_TIME, emails, moment, with_views

_BODY = "coalesce(body_text, '')"
_SPACES = r"\s\v\p{Z}\x1c-\x1f\x85"
_LETTERS = r"regexp_replace({c}, '[^\p{{L}}]+', '', 'g')"
_UPPERS = r"regexp_replace({c}, '[^\p{{Lu}}]+', '', 'g')"


def _count(char: str) -> str:
    return f"CAST(length({_BODY}) - length(replace({_BODY}, '{char}', '')) AS BIGINT)"


def _matches(pattern: str, cast: str = "BIGINT") -> str:
    escaped = pattern.replace("'", "''")
    return f"CAST(len(regexp_extract_all({_BODY}, '{escaped}')) AS {cast})"


_WORDS = _matches(f"[^{_SPACES}]+")
_L = _LETTERS.format(c=_BODY)
_U = _UPPERS.format(c=_BODY)


def _caps(min_letters: int) -> str:
    s = "coalesce(subject, '')"
    letters, uppers = f"length({_LETTERS.format(c=s)})", f"length({_UPPERS.format(c=s)})"
    return f"CAST({letters} >= {min_letters} AND {letters} = {uppers} AS INTEGER)"


def _time(expr: str, missing: int) -> str:
    return f"CAST(coalesce({expr}, {missing}) AS INTEGER)"


_DOW = "isodow(date) - 1"
_NIGHT = "CAST(hour(date) >= 22 OR hour(date) < 6 AS INTEGER)"
_DOMAIN = r"CASE WHEN contains(sender_email, '@') THEN regexp_extract(sender_email, '[^@]*$') ELSE '' END"
_DIGIT = r"CAST(regexp_matches({c}, '\p{{Nd}}') AS INTEGER)"

SQL_TRAIN = {
    "url_count": _matches(r"""https?://[^%s<>"{}|\\^`\[\]]+""" % _SPACES),
    "email_count_in_body": _matches(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    "uppercase_ratio": f"coalesce(CAST(length({_U}) AS DOUBLE) / nullif(length({_L}), 0), 0.0e0)",
    "exclamation_count": _count("!"),
    "question_mark_count": _count("?"),
    "avg_word_length": (
        f"coalesce(CAST(length(regexp_replace({_BODY}, '[{_SPACES}]+', '', 'g')) AS DOUBLE) / nullif({_WORDS}, 0), 0.0e0)"
    ),
    "word_count": _WORDS,
    "char_count": f"CAST(length({_BODY}) AS BIGINT)",
    "has_html": "CAST(length(coalesce(body_html, '')) > 0 AS INTEGER)",
    "html_to_text_ratio": (
        f"CASE WHEN length({_BODY}) = 0 THEN CAST(length(coalesce(body_html, '')) AS DOUBLE) "
        f"ELSE CAST(length(coalesce(body_html, '')) AS DOUBLE) / length({_BODY}) END"
    ),
    "subject_length": "CAST(length(coalesce(subject, '')) AS BIGINT)",
    "subject_has_re": "CAST(starts_with(lower(coalesce(subject, '')), 're:') AS INTEGER)",
    "subject_has_fwd": (
        "CAST(starts_with(lower(coalesce(subject, '')), 'fwd:') OR starts_with(lower(coalesce(subject, '')), 'fw:') AS INTEGER)"
    ),
    "subject_all_caps": _caps(3),
    "has_x_mailer": "CAST(length(coalesce(x_mailer, '')) > 0 AS INTEGER)",
    "sender_domain_length": "CAST(length(coalesce(sender_domain, '')) AS BIGINT)",
    "sender_has_numbers": _DIGIT.format(c="split_part(sender_email, '@', 1)"),
    "received_hop_count": "CAST(coalesce(received_hop_count, 0) AS BIGINT)",
    "hour_of_day": _time("hour(date)", -1),
    "day_of_week": _time(_DOW, -1),
    "is_weekend": _time(f"CAST({_DOW} >= 5 AS INTEGER)", -1),
    "is_night_hour": _time(_NIGHT, -1),
    "spam_keyword_count": "CAST("
    + " + ".join(f"CAST(contains(lower({_BODY}), '{p}') AS INTEGER)" for p in SPAM_PHRASES)
    + " AS BIGINT)",
    "has_unsubscribe": f"CAST(contains(lower({_BODY}), 'unsubscribe') AS INTEGER)",
}
SQL_PROFILES = {
    "train": SQL_TRAIN,
    "serve": {
        **SQL_TRAIN,
        "subject_all_caps": _caps(1),
        "hour_of_day": _time("hour(date)", 12),
        "day_of_week": _time(_DOW, 2),
        "is_weekend": _time(f"CAST({_DOW} >= 5 AS INTEGER)", 0),
        "is_night_hour": _time(_NIGHT, 0),
        "sender_domain_length": "CAST(length(regexp_extract(lower(sender_email), '[^@]*$')) AS BIGINT)",
    },
}
SQL_PROFILES["batch"] = {
    **SQL_PROFILES["serve"],
    "sender_domain_length": f"CAST(length({_DOMAIN}) AS BIGINT)",
    "sender_has_numbers": _DIGIT.format(c="sender_email"),
}

_CODES = {
    **{f: f"c{i:02d}" for i, f in enumerate(features.SCALARS, start=1)},
}
_NEEDS_HTML = {"has_html", "html_to_text_ratio"}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _one(feature: str):
    def run(spark, sf):
        df = emails(spark, sf, html=feature in _NEEDS_HTML, labels=False)
        return df.select("email_id", features.scalar_columns("train")[feature].alias(feature))

    sql = with_views(EMAILS_SQL, body=f"SELECT email_id, {_select({feature: SQL_TRAIN[feature]})} FROM emails")
    return run, sql


def _rows(profile: str):
    def run(spark, sf):
        return features.feature_rows(emails(spark, sf), moment(JOB_TIME), profile)

    cols = _select({f: SQL_PROFILES[profile][f] for f in features.SCALARS})
    sql = f"SELECT email_id, label, {cols}, TIMESTAMP '{JOB_TIME}' AS event_timestamp FROM emails"
    return run, with_views(EMAILS_SQL, body=sql)


def _variant(names: list[str]):
    """The named features in all three profiles side by side."""

    def run(spark, sf):
        df = emails(spark, sf, html=False, labels=False)
        per = {p: features.scalar_columns(p) for p in features.PROFILES}
        return df.select("email_id", *[per[p][n].alias(f"{n}_{p}") for p in per for n in names])

    cols = _select({f"{n}_{p}": SQL_PROFILES[p][n] for p in features.PROFILES for n in names})
    return run, with_views(EMAILS_SQL, body=f"SELECT email_id, {cols} FROM emails")


def _serving_domain(spark, sf):
    df = emails(spark, sf, html=False, labels=False)
    return df.select("email_id", structure.serving_domain_of("sender_email").alias("sender_domain"))


def _iso_dates(spark, sf):
    """Dates written as ISO text with Z, every third one broken, parsed back."""
    df = emails(spark, sf, html=False, labels=False)
    text = F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    broken = F.when(F.col("doc_id") % 3 == 0, F.lit("not a date")).otherwise(text)
    parsed = clock.parse_iso(broken)
    return df.select("email_id", F.unix_seconds(parsed).cast("double").alias("epoch"))


QUERIES = {f"{_CODES[f]}_{f}": _one(f) for f in features.SCALARS}
QUERIES |= {
    "c25_feature_rows": _rows("train"),
    "c25_feature_rows_serve": _rows("serve"),
    "c25_feature_rows_batch": _rows("batch"),
    "c27_serving_domain": (
        _serving_domain,
        with_views(EMAILS_SQL, body="SELECT email_id, regexp_extract(lower(sender_email), '[^@]*$') AS sender_domain FROM emails"),
    ),
    "c28_iso_dates": (
        _iso_dates,
        with_views(
            EMAILS_SQL,
            body="SELECT email_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(epoch(date) AS DOUBLE) END AS epoch FROM emails",
        ),
    ),
    "c29_all_caps_by_profile": _variant(["subject_all_caps"]),
    "c30_missing_date_by_profile": _variant(features.TIME),
    "c31_domain_length_by_profile": _variant(["sender_domain_length"]),
    "c32_sender_digits_by_profile": _variant(["sender_has_numbers"]),
}
