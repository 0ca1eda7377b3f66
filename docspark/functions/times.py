"""Time stamps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_iso(at: Column) -> Column:
    """ISO 8601 text in UTC, whatever the session's time zone; sorts by time."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
