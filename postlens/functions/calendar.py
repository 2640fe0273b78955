"""Calendar parts of a timestamp."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# dayofweek: 1 = Sunday ... 7 = Saturday.  The default weekend is days 6 and 7
# (Friday and Saturday), which is what a [1, 6, 7] bucket split yields.
DEFAULT_WEEKEND_DAYS = (6, 7)
CALENDAR_WEEKEND_DAYS = (1, 7)


def is_weekend(dow: Column | str, weekend_days: Iterable[int] = DEFAULT_WEEKEND_DAYS) -> Column:
    """1.0 for weekend days, 0.0 otherwise; null day stays null."""
    dow = F.col(dow) if isinstance(dow, str) else dow
    return (F.when(dow.isNull(), F.lit(None).cast("double"))
            .when(dow.isin(*list(weekend_days)), F.lit(1.0))
            .otherwise(F.lit(0.0)))
