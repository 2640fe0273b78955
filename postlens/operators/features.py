"""Per-post feature tables and the wide table that joins them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.calendar import DEFAULT_WEEKEND_DAYS
from ..session import cut_lineage
from ..sources.sinks import register_view
from .cleaning import binary_by_threshold, clean_posts, quantiles
from .sentiment import score_comments
from .text import join_by_word
from .timing import add_calendar

COMMENT_FEATURES_SQL = """
SELECT post_id,
       AVG(overall_sentiment) AS comments_sentiment,
       CAST(SUM(nbr_mentions) AS BIGINT) AS comments_nbr_mentions,
       CAST(SUM(is_verified_author) AS BIGINT) AS comments_nbr_verified
FROM {view}
WHERE post_id IS NOT NULL
GROUP BY post_id
"""


def comment_features(scored: DataFrame) -> DataFrame:
    """Per post: mean overall sentiment, total mentions, verified commenters.

    Hash aggregate with a map-side partial step, so a post holding a large
    share of all comments is pre-summed inside every task before the shuffle.
    No ORDER BY: the result feeds a join, where a sort is pure cost.
    """
    return (scored.where(F.col("post_id").isNotNull())
            .groupBy("post_id")
            .agg(F.avg("overall_sentiment").alias("comments_sentiment"),
                 F.sum("nbr_mentions").cast("bigint").alias("comments_nbr_mentions"),
                 F.sum("is_verified_author").cast("bigint").alias("comments_nbr_verified")))


def comment_features_sql(spark: SparkSession, scored: DataFrame,
                         view: str = "comments_sent_analysis") -> DataFrame:
    """The same aggregate written as SQL over a temp view."""
    register_view(scored, view)
    return spark.sql(COMMENT_FEATURES_SQL.format(view=view))


def sentiment_median(cf: DataFrame, rel_err: float = 0.0):
    q = quantiles(cf, "comments_sentiment", [0.5], rel_err)
    return q[0] if q else None


def assemble_features(posts: DataFrame, comments: DataFrame | None, *, likes_cuts: Sequence[int] | None = None,
                      median: float | None = None, rel_err: float = 0.0,
                      weekend_days: Iterable[int] = DEFAULT_WEEKEND_DAYS,
                      null_positivity_as: str | None = "low", keep_tokens: bool = False,
                      rollup: DataFrame | None = None) -> DataFrame:
    """Wide table: cleaned posts + calendar + text features + comment features
    + comment_positivity (above the median of comments_sentiment).

    Calendar and text features are computed on the posts rows themselves
    (row-local columns), so the only join is posts LEFT JOIN the per-post
    comment aggregate on post_id.  The cut values are the only driver trips.
    When the median is computed here, the per-post aggregate is check-pointed
    into the shared folder first, so comments are read once.

    ``rollup``: the per-post comment features, where they are kept already; tables written by
    ``write_bucketed`` on post_id make the join one without an exchange.
    """
    clean = clean_posts(posts, likes_cuts, rel_err)
    cf = comment_features(score_comments(comments)) if rollup is None else rollup
    if median is None and rollup is not None:
        median = sentiment_median(cf, rel_err)
    elif median is None:
        # the aggregate feeds both the median and the join: check-point it
        # (one row per post) so the comments are scanned and scored once
        cf = cut_lineage(cf)
        median = sentiment_median(cf, rel_err)
    # Text features are projections of the same post rows, so they are added
    # as columns rather than self-joined back on post_id.
    words_f = T.remove_stopwords(T.tokenize(T.clean_text("post_text")))
    with_text = (clean.withColumns({"has_mention": T.has_mention("post_text"),
                                    "has_hashtag": T.has_hashtag("post_text"), "_words_f": words_f})
                 .withColumn("vector_lemma", T.lemmatise("_words_f"))
                 .withColumn("nbr_words", F.size("vector_lemma"))
                 .drop("_words_f", *([] if keep_tokens else ["vector_lemma"])))
    return (add_calendar(with_text, weekend_days=weekend_days).drop("hour")
            .join(cf, "post_id", "left")
            .withColumns({
                "comments_nbr_mentions": F.col("comments_nbr_mentions").cast("double"),
                "comment_positivity": binary_by_threshold("comments_sentiment", median,
                                                          null_as=null_positivity_as),
                "year": F.col("year").cast("string"),
                "month": F.col("month").cast("string"),
                "dayofweek": F.col("dayofweek").cast("string")}))


def observed_values(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """The distinct non-null values of each column, sorted; one aggregate for all
    columns.  Meant for calendar parts, whose values are few."""
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: list(row[c] or ()) for c in cols}


def dummies(df: DataFrame, cols: Sequence[str] = ("year", "month", "dayofweek"),
            keep: Sequence[str] = (), drop_nulls: bool = True, values: Mapping[str, Sequence] | None = None) -> DataFrame:
    """One 0/1 column per observed value of each column (``{col}_{value}``),
    next to ``keep``; rows with a null in any kept column are dropped.

    The values name the columns, so they are brought back (one aggregate, or given
    as ``values``); for columns with many values use ``dummy_rows``."""
    values = values or observed_values(df, cols)
    out_cols = [F.col(c) for c in keep]
    out_cols += [(F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for c in cols for v in values[c]]
    out = df.select(*out_cols)
    return out.na.drop() if drop_nulls else out


def dummy_rows(df: DataFrame, id_col: str, cols: Sequence[str] = ("year", "month", "dayofweek")) -> DataFrame:
    """The set dummies in long form: (id, feature ``{col}_{value}``, value 1), with no
    list of values anywhere; nulls set none."""
    pairs = F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_"), F.col(c).cast("string")))
                                for c in cols])).alias("feature")
    return df.select(F.col(id_col), pairs).where("feature is not null").withColumn("value", F.lit(1))


def onehot_rows(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """One-hot vectors as rows (id, feature, place, value 1.0): the categories of each
    column by falling frequency (ties by value), the last one dropped.  ``place`` is
    the category's index in its column's block."""
    long = df.select(F.col(id_col), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                                        for c in cols])).alias("p")) \
        .select(id_col, "p.c", "p.v").where("v is not null")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("c").orderBy(F.desc("n"), "v")
    codes = (counts.withColumn("place", F.row_number().over(by_count) - 1)
             .withColumn("last", F.max("place").over(Window.partitionBy("c"))).where("place < last"))
    # category counts of a few columns; salted, since one category may hold most rows
    feature = F.concat("c", F.lit("_"), "v")
    return (join_by_word(long.withColumn("feature", feature), codes.select(feature.alias("feature"), "place"),
                         "feature", id_col).select(id_col, "feature", "place", F.lit(1.0).alias("value")))
