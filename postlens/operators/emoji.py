"""Emoji tables over scored comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emoji_counts(scored: DataFrame, id_col: str = "comment_id") -> DataFrame:
    """Long form of the per-comment emoji histogram: (id, emoji, n).
    Row-local explode of a map built inside each row; no shuffle."""
    return (scored.select(id_col, F.explode_outer("emojis_count").alias("emoji", "n"))
            .where(F.col("emoji").isNotNull()))


def top_emojis(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """Comments per first emoji, most frequent first.  The no-emoji group is
    kept and shows 0, because the count is over the (null) key column."""
    out = (scored.groupBy("unique_emoji").agg(F.count("unique_emoji").alias("n"))
           .orderBy(F.desc("n"), F.asc_nulls_first("unique_emoji")))
    return out.limit(top_k) if top_k else out
