"""Calendar features of posts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import DEFAULT_WEEKEND_DAYS, is_weekend


def add_calendar(df: DataFrame, ts: str = "post_timestamp",
                 weekend_days: Iterable[int] = DEFAULT_WEEKEND_DAYS) -> DataFrame:
    """year, month, dayofweek (1 = Sunday), hour and is_weekend (double)."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "dayofweek": F.dayofweek(ts),
                           "hour": F.hour(ts), "is_weekend": is_weekend(F.dayofweek(ts), weekend_days)})


def timing_features(posts: DataFrame, ts: str = "post_timestamp",
                    weekend_days: Iterable[int] = DEFAULT_WEEKEND_DAYS) -> DataFrame:
    """post_id, year, month, dayofweek, is_weekend (hour is left out)."""
    return add_calendar(posts, ts, weekend_days).select(
        "post_id", "year", "month", "dayofweek", "is_weekend")
