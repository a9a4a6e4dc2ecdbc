"""Row filters, column checks and defaulted projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import confidence_result, encode_label, label_name
from ..sources.tables import numeric_columns


def predicted(scored: DataFrame, spam: bool | None) -> DataFrame:
    """Rows predicted spam or ham; ``None`` keeps all."""
    return scored if spam is None else scored.where(F.col("spam_label") == (1 if spam else 0))


def drop_incomplete(df: DataFrame, columns: Sequence[str] = ("email_id", "label")) -> DataFrame:
    return df.na.drop(subset=list(columns))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def invalid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: how many non-NULL labels are neither 0 nor 1."""
    return df.agg(F.count_if(~F.col(label).isin(0, 1)).alias("invalid_labels"))


def require_binary_labels(df: DataFrame, label: str = "label") -> DataFrame:
    bad = invalid_labels(df, label).first()[0]
    if bad:
        raise ValueError(f"{bad} labels are not 0 or 1")
    return df


def with_default(df: DataFrame, column: str, default: Column) -> DataFrame:
    """The column itself when present, else the default."""
    return df if column in df.columns else df.withColumn(column, default)


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("email_id", "label", "event_timestamp", "sender_domain")) -> list[str]:
    """Numeric columns minus the excluded ones."""
    return [c for c in numeric_columns(df) if c not in set(exclude)]


def entity_table(emails: DataFrame, default_timestamp: Column) -> DataFrame:
    """email_id, event_timestamp, 0/1 label and (if present) sender_domain; incomplete rows dropped."""
    df = with_default(require_columns(emails, ["email_id", "label"]), "event_timestamp", default_timestamp)
    if dict(df.dtypes)["label"] == "string":
        df = df.withColumn("label", encode_label("label"))
    columns = ["email_id", "event_timestamp", "label"] + (["sender_domain"] if "sender_domain" in df.columns else [])
    return drop_incomplete(df.select(*columns))


def result_rows(scored: DataFrame) -> DataFrame:
    """The user-facing row of each prediction."""
    ids = [c for c in ("message_id", "email_id", "id") if c in scored.columns]
    bodies = [c for c in ("body_text", "body") if c in scored.columns]
    p = F.col("spam_probability")
    clip = lambda c, n: F.coalesce(F.left(c, F.lit(n)), F.lit(""))
    return scored.select(
        (F.col(ids[0]).cast("string") if ids else F.lit("")).alias("email_id"),
        clip(column_or(scored, "subject", F.lit("")), 100).alias("subject"),
        clip(F.col(bodies[0]) if bodies else F.lit(""), 200).alias("body_preview"),
        F.round(p, 4).alias("spam_probability"),
        label_name("spam_label").alias("spam_label"),
        confidence_result(p).alias("confidence"),
    )
