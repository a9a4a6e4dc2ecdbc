"""One row per key. Aggregates with partial combine, so a hot key never fills one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = F.max_by if largest else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), ordering).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the smallest ordering tuple per key (tuple must be unique per key)."""
    return _pick(df, keys, order, largest=False)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _pick(df, keys, order, largest=True)


def dedupe_content(emails: DataFrame, key: str = "email_id", tie: str = "filename") -> DataFrame:
    """One mail per content id, so later joins on it cannot multiply rows."""
    return first_per_key(emails, [key], [F.col(tie)])


def materialize(
    features: DataFrame, keys: Sequence[str], start: Column, end: Column, ts: str = "event_timestamp",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest feature row per key with start ≤ ts ≤ end."""
    inside = features.where((F.col(ts) >= start) & (F.col(ts) <= end))
    return last_per_key(inside, keys, [F.col(ts), *map(F.col, tie)])


def materialize_incremental(
    snapshot: DataFrame, features: DataFrame, keys: Sequence[str], last_end: Column, end: Column,
    ts: str = "event_timestamp", tie: Sequence[str] = (),
) -> DataFrame:
    """Rows newer than the last run merged over its snapshot."""
    fresh = features.where((F.col(ts) > last_end) & (F.col(ts) <= end))
    return last_per_key(snapshot.unionByName(fresh), keys, [F.col(ts), *map(F.col, tie)])
