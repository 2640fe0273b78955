"""Quantiles, quantile bands and post cleaning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import clean_bool_string
from ..session import cut_lineage


#: Distinct values that the last step of an exact quantile brings back at most.
FEW_VALUES = 20_000


def quantile_rows(df: DataFrame, col: str, probs: Sequence[float], few: int = FEW_VALUES) -> list[tuple[float, object]]:
    """Exact discrete quantiles (SQL ``percentile_disc``): for each p the smallest
    value whose cumulative count reaches ceil(p * n).  Returns [(prob, value)], empty
    when the column has no non-null value.

    Values are counted with a map-side combine.  Up to ``few`` distinct values the
    (value, count) table itself comes back, in one job.  Beyond that each quantile is
    bracketed by Spark's percentile sketch, one aggregate counts what lies below the
    bracket, and the values inside are looked at in the same way; a bracket holds a
    small share of the rows, so this ends after a step or two at any size.  These passes
    read the values from a table of this one column, so the plan behind ``df`` (joins,
    say) runs once.
    """
    values = cut_lineage(df.select(F.col(col).alias("v")).where(F.col("v").isNotNull()))
    rows = _value_counts(values, few)
    if rows is not None:
        n = sum(c for _, c in rows)
        return [(float(p), _at_rank(rows, _rank(p, n))) for p in probs] if n else []
    n = values.count()
    return [(float(p), _select(values, _rank(p, n), n, few)) for p in probs]


def _rank(p: float, n: int) -> int:
    return max(1, min(n, math.ceil(p * n)))


def _value_counts(values: DataFrame, few: int) -> list[tuple] | None:
    """Sorted (value, count) pairs, or None if there are more than ``few``."""
    rows = values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(few + 1).collect()
    return sorted((r["v"], r["n"]) for r in rows) if len(rows) <= few else None


def _at_rank(rows: list[tuple], k: int):
    seen = 0
    for v, n in rows:
        seen += n
        if seen >= k:
            return v
    return rows[-1][0]


def _select(values: DataFrame, k: int, n: int, few: int):
    """The k-th of n values."""
    slack = 2e-4
    while True:
        p = k / n
        lo, hi = values.agg(F.percentile_approx("v", [max(0.0, p - slack), min(1.0, p + slack)], 100_000)).first()[0]
        below, upto = values.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi)).first()
        if not below < k <= upto:
            slack *= 4
            continue
        inside = values.where(F.col("v").between(lo, hi))
        rows = _value_counts(inside, few)
        if rows is not None:
            return _at_rank(rows, k - below)
        if upto - below >= n:
            slack /= 8  # the bracket did not shrink
        values, k, n = inside, k - below, upto - below


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """``quantile_rows`` as a (prob, value) frame of at most len(probs) rows."""
    vtype = dict(df.dtypes)[col]
    return df.sparkSession.createDataFrame(quantile_rows(df, col, probs), f"prob double, value {vtype}")


def quantiles(df: DataFrame, col: str, probs: Sequence[float], rel_err: float = 0.0) -> list:
    """Quantile cut values as a small driver-side list (one per prob).

    ``rel_err > 0`` uses Spark's bounded-memory sketch (approxQuantile);
    ``rel_err == 0`` the exact distributed method above.  An all-null column
    gives ``[]`` in both cases.
    """
    if rel_err > 0:
        return df.approxQuantile(col, list(probs), rel_err)
    return [v for _, v in quantile_rows(df, col, probs)]


def band_by_quantiles(c: Column | str, cuts: Sequence, labels: Sequence[str] = ("low", "medium", "high")) -> Column:
    """< cuts[0] -> labels[0], < cuts[1] -> labels[1], >= cuts[-1] -> last label;
    null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    expr = F.when(c < F.lit(cuts[0]), F.lit(labels[0]))
    for cut, lab in zip(cuts[1:], labels[1:-1]):
        expr = expr.when(c < F.lit(cut), F.lit(lab))
    return expr.when(c >= F.lit(cuts[-1]), F.lit(labels[-1]))


def binary_by_threshold(c: Column | str, threshold, null_as: str | None = "low",
                        labels: tuple[str, str] = ("low", "high")) -> Column:
    """> threshold -> 'high', otherwise 'low'.  Null input gives ``null_as``
    ('low' by default, as an otherwise-branch would; pass None to keep null)."""
    c = F.col(c) if isinstance(c, str) else c
    if threshold is None:
        return F.when(c.isNull(), F.lit(null_as)).otherwise(F.lit(None).cast("string"))
    expr = F.when(c > F.lit(threshold), F.lit(labels[1]))
    if null_as is None:
        return expr.when(c.isNotNull(), F.lit(labels[0]))
    return expr.otherwise(F.lit(labels[0]))


LIKES_PROBS = (0.30, 0.60)
DROPPED_POST_COLUMNS = ("post_name", "nbr_pictures", "google_maps_url", "location")


def likes_cuts(posts: DataFrame, probs: Sequence[float] = LIKES_PROBS, rel_err: float = 0.0) -> list[int]:
    """Quantiles of nbr_likes truncated to int; [] when there are no likes."""
    return [int(q) for q in quantiles(posts, "nbr_likes", probs, rel_err)]


def clean_posts(posts: DataFrame, cuts: Sequence[int] | None = None, rel_err: float = 0.0) -> DataFrame:
    """Flags to int, likes banded by their 30/60% quantiles, unused columns
    dropped.  ``post_name`` is listed among the drops but does not exist, so
    profile_name survives (dropping a missing column is a no-op)."""
    cuts = likes_cuts(posts, rel_err=rel_err) if cuts is None else list(cuts)
    band = (band_by_quantiles("nbr_likes", cuts) if cuts
            else F.lit(None).cast("string"))
    return (posts.withColumns({"is_video": clean_bool_string("is_video"),
                               "is_multiple_pictures": F.col("is_multiple_pictures").cast("int"),
                               "likes_level": band})
            .drop(*DROPPED_POST_COLUMNS))
