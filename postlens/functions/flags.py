"""Flag normalisation for messy boolean-ish string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_bool_string(c: Column | str) -> Column:
    """'True' (optionally followed by carriage returns) -> 1, other text -> 0,
    null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.regexp_replace(c, "\r", "") == F.lit("True")).cast("int")


def normalise_flag(c: Column | str) -> Column:
    """'True' or a number equal to 1 -> 1; 'False', a number equal to 0,
    'Not found' or null -> 0; anything else -> null (ignored by SUM).

    Comparison is string-first: a string column is never compared with a
    double directly, which raises under ANSI mode.
    """
    c = F.col(c) if isinstance(c, str) else c
    num = c.try_cast("double")
    return (F.when(c == F.lit("True"), F.lit(1))
            .when(num == F.lit(1.0), F.lit(1))
            .when(c == F.lit("False"), F.lit(0))
            .when(num == F.lit(0.0), F.lit(0))
            .when(c == F.lit("Not found"), F.lit(0))
            .when(c.isNull(), F.lit(0))
            .otherwise(F.lit(None).cast("int")))
