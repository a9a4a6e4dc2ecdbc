"""The 24 scalar message features in their fixed order, in three profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clock, structure, text

TEXT = [
    "url_count", "email_count_in_body", "uppercase_ratio", "exclamation_count",
    "question_mark_count", "avg_word_length", "word_count", "char_count",
]
STRUCTURE = [
    "has_html", "html_to_text_ratio", "subject_length", "subject_has_re", "subject_has_fwd",
    "subject_all_caps", "has_x_mailer", "sender_domain_length", "sender_has_numbers",
    "received_hop_count",
]
TIME = ["hour_of_day", "day_of_week", "is_weekend", "is_night_hour"]
INDICATORS = ["spam_keyword_count", "has_unsubscribe"]
SENDER = ["email_count", "spam_count", "ham_count", "spam_ratio"]

SCALARS = TEXT + STRUCTURE + TIME + INDICATORS
KEY_FEATURES = SCALARS + SENDER
TFIDF_SIZE = 500


def vector_names(tfidf_size: int = TFIDF_SIZE) -> list[str]:
    """Order of the full feature vector: scalars, TF-IDF block, sender block."""
    return SCALARS + [f"tfidf_{i}" for i in range(tfidf_size)] + SENDER


@dataclass(frozen=True)
class Profile:
    """Where training, online serving and batch scoring disagree."""

    caps_letters: int
    hour: int
    weekday: int
    weekend: int
    night: int
    sender: dict[str, float]
    domain: str  # stored | serving | address
    digits_in: str  # local | address


PROFILES = {
    "train": Profile(3, -1, -1, -1, -1, dict(zip(SENDER, (0.0, 0.0, 0.0, 0.0))), "stored", "local"),
    "serve": Profile(1, 12, 2, 0, 0, dict(zip(SENDER, (122.0, 18.0, 104.0, 0.15))), "serving", "local"),
    "batch": Profile(1, 12, 2, 0, 0, dict(zip(SENDER, (0.0, 0.0, 0.0, 0.5))), "address", "address"),
}


def scalar_columns(profile: str = "train") -> dict[str, Column]:
    """Feature name → expression over the ``emails`` columns."""
    p = PROFILES[profile]
    domain = {
        "stored": text.text_or_empty("sender_domain"),
        "serving": structure.serving_domain_of("sender_email"),
        "address": structure.domain_of("sender_email"),
    }[p.domain]
    digits = structure.local_part("sender_email") if p.digits_in == "local" else F.col("sender_email")
    body, html, subject = "body_text", "body_html", "subject"
    return {
        "url_count": text.url_count(body),
        "email_count_in_body": text.address_count(body),
        "uppercase_ratio": text.uppercase_ratio(body),
        "exclamation_count": text.occurrences(body, "!"),
        "question_mark_count": text.occurrences(body, "?"),
        "avg_word_length": text.avg_word_length(body),
        "word_count": text.word_count(body),
        "char_count": text.char_count(body),
        "has_html": structure.present(html),
        "html_to_text_ratio": structure.html_to_text_ratio(body, html),
        "subject_length": text.char_count(subject),
        "subject_has_re": structure.subject_is_reply(subject),
        "subject_has_fwd": structure.subject_is_forward(subject),
        "subject_all_caps": structure.subject_all_caps(subject, p.caps_letters),
        "has_x_mailer": structure.present("x_mailer"),
        "sender_domain_length": F.length(domain).cast("long"),
        "sender_has_numbers": structure.has_digit(digits),
        "received_hop_count": structure.hop_count("received_hop_count"),
        "hour_of_day": clock.hour_of_day("date", p.hour),
        "day_of_week": clock.day_of_week("date", p.weekday),
        "is_weekend": clock.is_weekend("date", p.weekend),
        "is_night_hour": clock.is_night_hour("date", p.night),
        "spam_keyword_count": text.spam_phrase_count(body),
        "has_unsubscribe": text.has_unsubscribe(body),
    }


def feature_rows(
    emails: DataFrame, event_timestamp: Column, profile: str = "train", keep: tuple[str, ...] = ("email_id", "label")
) -> DataFrame:
    """All scalars of every message in one projection (no shuffle, no Python)."""
    scalars = [c.alias(n) for n, c in scalar_columns(profile).items()]
    return emails.select(*keep, *scalars, event_timestamp.alias("event_timestamp"))
