"""Send-time features and date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_column


def hour_of_day(ts: Column | str, missing: int) -> Column:
    return F.coalesce(F.hour(as_column(ts)), F.lit(missing)).cast("int")


def day_of_week(ts: Column | str, missing: int) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.coalesce(F.weekday(as_column(ts)), F.lit(missing)).cast("int")


def is_weekend(ts: Column | str, missing: int) -> Column:
    return F.coalesce((F.weekday(as_column(ts)) >= 5).cast("int"), F.lit(missing))


def is_night_hour(ts: Column | str, missing: int) -> Column:
    h = F.hour(as_column(ts))
    return F.coalesce(((h >= 22) | (h < 6)).cast("int"), F.lit(missing))


def parse_iso(c: Column | str) -> Column:
    """ISO-8601 text, ``Z`` or offset allowed; anything else is NULL."""
    return F.try_to_timestamp(as_column(c))
