"""Registered queries over the test tables.

Each entry is (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None).
The Spark side uses only the library's operators over the posts/comments
stand-ins; the SQL side restates the same semantics for DuckDB.  Column
names match between the two.  Double results built from floating sums are
rounded to 6 decimals on both sides so the comparison is order-insensitive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import POLARITY_LEXICON, VERB_LEMMAS
from ..operators import features as FE
from ..operators.sentiment import score_comments
from ..session import cut_lineage
from ..sources import testviews
from ..sources.testviews import with_views
from . import sqlgen as S

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        CATALOG[name] = (fn, sql)
        return fn
    return deco


def _read_partitions(spark: SparkSession) -> int | None:
    """How many partitions the session wants small input files dealt over, if any."""
    return int(spark.conf.get("spark.postlens.readPartitions", "0")) or None


def comments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testviews.comments_view(spark, sf_dir, _read_partitions(spark))


def posts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testviews.posts_view(spark, sf_dir, _read_partitions(spark))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_comments(comments_view(spark, sf_dir))


def _scored_cte(body: str, posts: bool = False, extra_ctes: str = "") -> str:
    """Query body over the `scored` CTE (plus optional further CTEs)."""
    more = f",\n{extra_ctes.strip()}" if extra_ctes else ""
    return with_views(f"WITH scored AS ({S.SCORED_SQL}){more}\n{body}", posts=posts, comments=True)


# --- A1: per-post comment rollup (flagship) --------------------------------

@register("comment_features", _scored_cte(f"SELECT * FROM ({S.COMMENT_FEATURES_SQL}) cf"))
def q_comment_features(spark, sf_dir):
    return FE.comment_features(_scored(spark, sf_dir))


@register("comment_features_sql", _scored_cte(f"SELECT * FROM ({S.COMMENT_FEATURES_SQL}) cf"))
def q_comment_features_sql(spark, sf_dir):
    return FE.comment_features_sql(spark, _scored(spark, sf_dir))


# --- helpers ----------------------------------------------------------------

def _r(c: str, d: int = 6):
    return F.round(F.col(c), d).alias(c)


def _posts(spark, sf_dir):
    return posts_view(spark, sf_dir)


def _posts_cte(body: str) -> str:
    return with_views(body, posts=True, comments=False)


def _clean_cte(body: str) -> str:
    b = body.strip()
    inner = b[4:].lstrip() if re.match(r"(?i)with\s", b) else None
    ctes = S.POSTS_CLEAN_CTES + (",\n" + inner if inner else "")
    return with_views("WITH " + ctes + ("" if inner else "\n" + b), posts=True, comments=False)


def _wide_cte(body: str) -> str:
    b = body.strip()
    inner = b[4:].lstrip() if re.match(r"(?i)with\s", b) else None
    ctes = (f"scored AS ({S.SCORED_SQL}),\n" + S.POSTS_CLEAN_CTES + ",\n" + S.WIDE_CTES
            + (",\n" + inner if inner else ""))
    return with_views("WITH " + ctes + ("" if inner else "\n" + b), posts=True, comments=True)


def recursive(sql: str) -> str:
    """The same query with recursive CTEs allowed."""
    return "WITH RECURSIVE" + sql[4:]


from ..operators import cleaning as CL  # noqa: E402
from ..operators import emoji as EM  # noqa: E402
from ..operators import evaluation as EV  # noqa: E402
from ..operators import profiling as PR  # noqa: E402
from ..operators import sentiment as SE  # noqa: E402
from ..operators import text as TX  # noqa: E402
from ..operators.timing import add_calendar, timing_features  # noqa: E402
from . import ml as ML  # noqa: E402

PROFILE_COLS = ("post_id", "profile_name", "post_text", "nbr_pictures", "google_maps_url",
                "location", "nbr_likes", "nbr_comments", "is_video")
NUMERIC_PROFILE = {"nbr_pictures", "nbr_likes", "nbr_comments"}


# --- P1-P8 profiling ----------------------------------------------------------

def _summary_sql() -> str:
    parts = []
    for c in PROFILE_COLS:
        num = c in NUMERIC_PROFILE
        mean = f"round(avg({c}), 6)" if num else "CAST(NULL AS DOUBLE)"
        sd = f"round(stddev_samp({c}), 6)" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS n, {mean} AS mean, {sd} AS stddev, "
                     f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM posts")
    return _posts_cte("\nUNION ALL\n".join(parts))


@register("posts_summary_stats", _summary_sql())
def q_summary(spark, sf_dir):
    return PR.summary_stats(_posts(spark, sf_dir), list(PROFILE_COLS)).select(
        "column_name", "n", _r("mean"), _r("stddev"), "min_value", "max_value")


POST_COLS = ("post_id", "profile_name", "post_timestamp", "post_text", "nbr_pictures", "is_multiple_pictures",
             "google_maps_url", "location", "nbr_likes", "nbr_comments", "is_video")


@register("posts_null_counts", _posts_cte(
    "SELECT " + ", ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in POST_COLS) + " FROM posts"))
def q_nulls(spark, sf_dir):
    return PR.null_counts(_posts(spark, sf_dir))


@register("distinct_post_ids", _posts_cte("SELECT count(DISTINCT post_id) AS n_distinct FROM posts"))
def q_distinct_ids(spark, sf_dir):
    return PR.distinct_count(_posts(spark, sf_dir), "post_id")


@register("distinct_profiles", _posts_cte("SELECT count(DISTINCT profile_name) AS n_distinct FROM posts"))
def q_distinct_profiles(spark, sf_dir):
    return PR.distinct_count(_posts(spark, sf_dir), "profile_name")


def _group_distinct(by: str):
    sql = _posts_cte(f"SELECT {by}, count(DISTINCT post_id) AS n_distinct FROM posts GROUP BY {by}")

    def fn(spark, sf_dir):
        return PR.group_distinct_count(_posts(spark, sf_dir), by, "post_id")
    return fn, sql


for _by in ("nbr_pictures", "is_multiple_pictures", "location", "is_video"):
    _fn, _sql = _group_distinct(_by)
    register(f"posts_by_{_by}", _sql)(_fn)


@register("posts_with_location_url", _posts_cte(
    "SELECT post_id, google_maps_url, location, nbr_likes FROM posts WHERE google_maps_url IS NOT NULL"))
def q_with_url(spark, sf_dir):
    return PR.non_null_rows(_posts(spark, sf_dir), "google_maps_url").select(
        "post_id", "google_maps_url", "location", "nbr_likes")


def _hist_sql(col: str, width: float) -> str:
    return _posts_cte(f"""
SELECT bin, CAST(0.0 + bin * {width} AS DOUBLE) AS bin_lo, CAST(0.0 + (bin + 1) * {width} AS DOUBLE) AS bin_hi,
       count(*) AS n
FROM (SELECT CAST(floor(({col} - 0.0) / {width}) AS BIGINT) AS bin FROM posts WHERE {col} IS NOT NULL) b
GROUP BY bin""")


@register("likes_histogram", _hist_sql("nbr_likes", 10000.0))
def q_likes_hist(spark, sf_dir):
    return PR.histogram(_posts(spark, sf_dir), "nbr_likes", 10000.0)


@register("comments_histogram", _hist_sql("nbr_comments", 25.0))
def q_comments_hist(spark, sf_dir):
    return PR.histogram(_posts(spark, sf_dir), "nbr_comments", 25.0)


KDE_BW, KDE_STEP = 0.1, 0.02
KDE_REACH = math.ceil(3.0 * KDE_BW / KDE_STEP)  # the default margin of 3 bandwidths


@register("sentiment_density", _scored_cte(f"""
SELECT grid, CAST(0.0 + grid * {KDE_STEP} AS DOUBLE) AS x,
       round(sum(n * exp(-0.5 * ((grid - cell) * {KDE_STEP} / {KDE_BW}) * ((grid - cell) * {KDE_STEP} / {KDE_BW})))
             / (max(n_total) * {KDE_BW} * sqrt(2 * pi())), 6) AS density
FROM cells, g, tot GROUP BY grid""", extra_ctes=f"""
cf AS ({S.COMMENT_FEATURES_SQL}),
cells AS (SELECT CAST(round((comments_sentiment - 0.0) / {KDE_STEP}) AS BIGINT) AS cell, count(*) AS n
          FROM cf WHERE comments_sentiment IS NOT NULL GROUP BY 1),
tot AS (SELECT count(*) AS n_total FROM cf WHERE comments_sentiment IS NOT NULL),
g AS (SELECT unnest(range(min(cell) - {KDE_REACH}, max(cell) + {KDE_REACH} + 1)) AS grid FROM cells)"""))
def q_kde(spark, sf_dir):
    cf = FE.comment_features(_scored(spark, sf_dir))
    return PR.kde(cf, "comments_sentiment", KDE_BW, KDE_STEP, lo=0.0).select("grid", "x", _r("density"))


def _density_sql(col: str) -> str:
    """Scott's bandwidth over a grid of 64 cells from the minimum to the maximum."""
    return _posts_cte(f"""WITH
v AS (SELECT CAST({col} AS DOUBLE) AS v FROM posts WHERE {col} IS NOT NULL),
par AS (SELECT count(*) AS n, min(v) AS lo, (max(v) - min(v)) / 64 AS step,
               stddev_samp(v) * pow(count(*), -0.2) AS bw FROM v),
cells AS (SELECT CAST(round((v - lo) / step) AS BIGINT) AS cell, count(*) AS k FROM v, par GROUP BY 1),
g AS (SELECT unnest(range(min(cell) - CAST(max(ceil(3.0 * bw / step)) AS BIGINT),
                          max(cell) + CAST(max(ceil(3.0 * bw / step)) AS BIGINT) + 1)) AS grid FROM cells, par)
SELECT grid, round(max(lo) + grid * max(step), 4) AS x,
       round(1000 * sum(k * exp(-0.5 * ((grid - cell) * step / bw) * ((grid - cell) * step / bw)))
             / (max(n) * max(bw) * sqrt(2 * pi())), 6) AS density_per_1000
FROM cells, g, par GROUP BY grid""")


def _density(col: str):
    def fn(spark, sf_dir):
        d = PR.kde(_posts(spark, sf_dir), col, grid=64)
        return d.select("grid", _r("x", 4), F.round(1000 * F.col("density"), 6).alias("density_per_1000"))
    return fn


register("likes_density", _density_sql("nbr_likes"))(_density("nbr_likes"))
register("comments_density", _density_sql("nbr_comments"))(_density("nbr_comments"))


@register("likes_comments_bins", _posts_cte("""
SELECT CAST(floor(nbr_likes / 50000.0) AS BIGINT) AS bx, CAST(floor(nbr_comments / 50.0) AS BIGINT) AS by,
       count(*) AS n
FROM posts WHERE nbr_likes IS NOT NULL AND nbr_comments IS NOT NULL GROUP BY 1, 2"""))
def q_pair_bins(spark, sf_dir):
    return PR.pair_density(_posts(spark, sf_dir), "nbr_likes", "nbr_comments", 50000.0, 50.0)


@register("likes_comments_corr", _posts_cte("""
SELECT round(corr(nbr_likes, nbr_comments), 6) AS corr, count(*) AS n
FROM posts WHERE nbr_likes IS NOT NULL AND nbr_comments IS NOT NULL"""))
def q_pair_corr(spark, sf_dir):
    return PR.pair_corr(_posts(spark, sf_dir), "nbr_likes", "nbr_comments").select(_r("corr"), "n")


def _mean_by_sql(y: str) -> str:
    parts = []
    for d in ("year", "month", "dayofweek", "hour"):
        parts.append(f"""SELECT '{d}' AS dimension, CAST({d} AS BIGINT) AS value, count({y}) AS n,
       round(avg({y}), 6) AS mean, round(stddev_samp({y}), 6) AS sd,
       round(avg({y}) - 1.96 * stddev_samp({y}) / sqrt(count({y})), 6) AS ci_lo,
       round(avg({y}) + 1.96 * stddev_samp({y}) / sqrt(count({y})), 6) AS ci_hi
FROM cal GROUP BY {d}""")
    return _posts_cte(f"WITH cal AS (SELECT *, {S.calendar_cols()} FROM posts)\n" + "\nUNION ALL\n".join(parts))


def _mean_by(y: str):
    def fn(spark, sf_dir):
        cal = add_calendar(_posts(spark, sf_dir))
        return PR.mean_by(cal, ["year", "month", "dayofweek", "hour"], y).select(
            "dimension", "value", "n", _r("mean"), _r("sd"), _r("ci_lo"), _r("ci_hi"))
    return fn


register("likes_by_calendar", _mean_by_sql("nbr_likes"))(_mean_by("nbr_likes"))
register("comments_by_calendar", _mean_by_sql("nbr_comments"))(_mean_by("nbr_comments"))


# --- C1-C8 cleaning, quantiles, bands ----------------------------------------

@register("likes_quantiles", _posts_cte("""
SELECT CAST(0.3 AS DOUBLE) AS prob, quantile_disc(nbr_likes, 0.3) AS value FROM posts
UNION ALL SELECT CAST(0.6 AS DOUBLE) AS prob, quantile_disc(nbr_likes, 0.6) AS value FROM posts"""))
def q_likes_quantiles(spark, sf_dir):
    return CL.exact_quantiles(_posts(spark, sf_dir), "nbr_likes", [0.3, 0.6])


@register("posts_clean", _clean_cte("SELECT * FROM posts_clean"))
def q_posts_clean(spark, sf_dir):
    return CL.clean_posts(_posts(spark, sf_dir))


@register("likes_level_counts", _clean_cte(
    "SELECT likes_level, count(*) AS n FROM posts_clean GROUP BY likes_level"))
def q_likes_levels(spark, sf_dir):
    return CL.clean_posts(_posts(spark, sf_dir)).groupBy("likes_level").agg(F.count(F.lit(1)).alias("n"))


# --- D1-D3 calendar -------------------------------------------------------------

@register("timing_features", _posts_cte(
    f"SELECT post_id, year, month, dayofweek, is_weekend FROM (SELECT post_id, {S.calendar_cols()} FROM posts) t"))
def q_timing(spark, sf_dir):
    return timing_features(_posts(spark, sf_dir))


# --- T1-T11, N1, F3b text --------------------------------------------------------

def _post_text_sql() -> str:
    words_f = S.remove_stop(S.tokens(S.clean_text("post_text")))
    return _posts_cte(f"""
SELECT post_id, {S.has_sub('post_text', '@')} AS has_mention, {S.has_sub('post_text', '#')} AS has_hashtag,
       CAST(len(lemmas) AS INTEGER) AS nbr_words,
       array_to_string(words_f, ' ') AS text_words_f,
       array_to_string(lemmas, ' ') AS vector_lemma,
       array_to_string({S.stem_tokens('words_f')}, ' ') AS vector_stemmed
FROM (SELECT post_id, post_text, words_f, {S.lemmatise('words_f')} AS lemmas
      FROM (SELECT post_id, post_text, {words_f} AS words_f FROM posts) a) b""")


@register("post_text_features", _post_text_sql())
def q_post_text(spark, sf_dir):
    tf = TX.text_features(_posts(spark, sf_dir))
    return tf.select("post_id", "has_mention", "has_hashtag", "nbr_words",
                     F.array_join("text_words_f", " ").alias("text_words_f"),
                     F.array_join("vector_lemma", " ").alias("vector_lemma"),
                     F.array_join("vector_stemmed", " ").alias("vector_stemmed"))


def _lemmas_sql_cte() -> str:
    words_f = S.remove_stop(S.tokens(S.clean_text("post_text")))
    return f"lem AS (SELECT post_id, {S.lemmatise(words_f)} AS lemmas FROM posts)"


@register("post_top_words", _posts_cte(f"""WITH {_lemmas_sql_cte()}
SELECT trim(lower(w)) AS post_word, count(*) AS count
FROM (SELECT unnest(list_distinct(lemmas)) AS w FROM lem) u WHERE length(w) > 0 GROUP BY 1"""))
def q_post_top_words(spark, sf_dir):
    tf = TX.text_features(_posts(spark, sf_dir))
    return TX.word_frequency(tf, "vector_lemma", "post_word", distinct_per_row=True)


@register("post_top_words_25", _posts_cte(f"""WITH {_lemmas_sql_cte()}
SELECT trim(lower(w)) AS post_word, count(*) AS count
FROM (SELECT unnest(list_distinct(lemmas)) AS w FROM lem) u WHERE length(w) > 0 GROUP BY 1
ORDER BY count DESC, post_word LIMIT 25"""))
def q_post_top_words_25(spark, sf_dir):
    tf = TX.text_features(_posts(spark, sf_dir))
    return TX.word_frequency(tf, "vector_lemma", "post_word", distinct_per_row=True, top_k=25)


@register("comment_top_words", _scored_cte(f"""
SELECT trim(lower(w)) AS word, count(*) AS count
FROM (SELECT unnest({S.lemmatise('comment_words_f')}) AS w FROM scored) u WHERE length(w) > 0 GROUP BY 1"""))
def q_comment_top_words(spark, sf_dir):
    from ..functions.text import lemmatise
    sc = _scored(spark, sf_dir).withColumn("comment_words_l", lemmatise("comment_words_f"))
    return TX.word_frequency(sc, "comment_words_l", "word", distinct_per_row=True)


@register("comment_top_words_100", _scored_cte(f"""
SELECT trim(lower(w)) AS word, count(*) AS count
FROM (SELECT unnest({S.lemmatise('comment_words_f')}) AS w FROM scored) u WHERE length(w) > 0 GROUP BY 1
ORDER BY count DESC, word LIMIT 100"""))
def q_comment_top_words_100(spark, sf_dir):
    from ..functions.text import lemmatise
    sc = _scored(spark, sf_dir).withColumn("comment_words_l", lemmatise("comment_words_f"))
    return TX.word_frequency(sc, "comment_words_l", "word", distinct_per_row=True, top_k=100)


def _slice_words_sql(cond: str, name: str) -> str:
    return _scored_cte(f"""
SELECT trim(lower(w)) AS {name}, count(*) AS count
FROM (SELECT unnest(comment_words_f) AS w FROM scored WHERE {cond}) u WHERE length(w) > 0 GROUP BY 1""")


@register("positive_comment_words", _slice_words_sql("polarity >= 0.75", "p_word"))
def q_pos_words(spark, sf_dir):
    pos = SE.extreme_comments(_scored(spark, sf_dir), side="positive")
    return TX.word_frequency(pos, "comment_words_f", "p_word")


@register("negative_comment_words", _slice_words_sql("polarity <= -0.5", "n_word"))
def q_neg_words(spark, sf_dir):
    neg = SE.extreme_comments(_scored(spark, sf_dir), side="negative")
    return TX.word_frequency(neg, "comment_words_f", "n_word")


@register("post_tfidf", _posts_cte(f"""WITH {_lemmas_sql_cte()},
tf AS (SELECT post_id, w AS word, count(*) AS tf FROM (SELECT post_id, unnest(lemmas) AS w FROM lem) u GROUP BY 1, 2),
dfq AS (SELECT word, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1),
nd AS (SELECT count(*) AS n FROM posts)
SELECT tf.post_id, tf.word, tf.tf, dfq.df, dfq.cf,
       round(CASE WHEN dfq.df < 100 THEN 0.0 ELSE ln((nd.n + 1.0) / (dfq.df + 1)) END, 6) AS idf,
       round(tf.tf * CASE WHEN dfq.df < 100 THEN 0.0 ELSE ln((nd.n + 1.0) / (dfq.df + 1)) END, 6) AS tfidf
FROM tf JOIN dfq USING (word) CROSS JOIN nd"""))
def q_tfidf(spark, sf_dir):
    tf = TX.text_features(_posts(spark, sf_dir))
    return TX.tfidf_table(tf, "post_id", "vector_lemma", min_doc_freq=ML.IDF_MIN_DOC_FREQ,
                          distinct_words=True).select(
        "post_id", "word", "tf", "df", "cf", _r("idf"), _r("tfidf"))


@register("post_tokens_normalised", _posts_cte(f"""
SELECT post_id, array_to_string(list_transform({S.remove_stop(S.tokens(S.clean_text('post_text')))},
       lambda x: coalesce(({S.smap(VERB_LEMMAS)})[x], x)),
       ' ') AS normalised FROM posts"""))
def q_normalised(spark, sf_dir):
    tf = TX.text_features(_posts(spark, sf_dir))
    dic = spark.createDataFrame(sorted(VERB_LEMMAS.items()), "surface string, base string")
    # fixed dictionary of len(VERB_LEMMAS) rows: a proven bound for the broadcast
    out = TX.normalise_vocabulary(tf, "post_id", "text_words_f", dic, broadcast_dictionary=True)
    return out.select("post_id", F.array_join("normalised", " ").alias("normalised"))


def _verb_base_sql(w: str) -> str:
    """The endings rule, spelled out for DuckDB."""
    stem = f"regexp_replace({w}, '(ing|ed)$', '')"
    doubled = ", ".join(f"'{c}{c}'" for c in "bdfgmnprt")
    return f"""(CASE WHEN {w} IN ({", ".join(S.q(k) for k in sorted(VERB_LEMMAS))}) THEN ({S.smap(VERB_LEMMAS)})[{w}]
  WHEN length({w}) >= 5 AND (ends_with({w}, 'ies') OR ends_with({w}, 'ied')) THEN left({w}, -3) || 'y'
  WHEN (ends_with({w}, 'ing') OR ends_with({w}, 'ed')) AND length({stem}) >= 3 AND regexp_matches({stem}, '[aeiouy]')
    THEN CASE WHEN right({stem}, 2) IN ({doubled}) THEN left({stem}, -1) ELSE {stem} END
  WHEN regexp_matches({w}, '^.{{2,}}(ss|sh|ch|x)es$') THEN left({w}, -2)
  WHEN length({w}) >= 4 AND ends_with({w}, 's') AND left(right({w}, 2), 1) NOT IN ('s', 'u', 'i') THEN left({w}, -1)
  ELSE {w} END)"""


@register("vocabulary_normalised", _posts_cte(f"""
SELECT w AS word, count(*) AS n_rows, {_verb_base_sql('w')} AS base
FROM (SELECT unnest(list_distinct({S.remove_stop(S.tokens(S.clean_text('post_text')))})) AS w FROM posts) u GROUP BY w"""))
def q_vocabulary(spark, sf_dir):
    return TX.vocabulary_bases(TX.text_features(_posts(spark, sf_dir)), "text_words_f")


# --- M1-M9 sentiment and emoji ------------------------------------------------------

@register("comment_sentiment", _scored_cte("""
SELECT comment_id, post_id, nbr_mentions, is_verified_author, round(polarity, 6) AS polarity, label,
       array_to_string(emojis, ' ') AS emojis, emojis[1] AS unique_emoji, sentiment_emoji, overall_sentiment
FROM scored"""))
def q_comment_sentiment(spark, sf_dir):
    sc = _scored(spark, sf_dir)
    return sc.select("comment_id", "post_id", "nbr_mentions", "is_verified_author", _r("polarity"), "label",
                     F.array_join("emojis", " ").alias("emojis"), "unique_emoji", "sentiment_emoji",
                     "overall_sentiment")


@register("emoji_counts", _scored_cte("""
SELECT comment_id, e AS emoji, CAST(count(*) AS INTEGER) AS n
FROM (SELECT comment_id, unnest(emojis) AS e FROM scored) u GROUP BY 1, 2"""))
def q_emoji_counts(spark, sf_dir):
    return EM.emoji_counts(_scored(spark, sf_dir))


@register("top_emojis", _scored_cte("""
SELECT emojis[1] AS unique_emoji, count(emojis[1]) AS n FROM scored GROUP BY 1"""))
def q_top_emojis(spark, sf_dir):
    return EM.top_emojis(_scored(spark, sf_dir))


@register("polarity_lexicon_join", _scored_cte("SELECT comment_id, round(polarity, 6) AS polarity FROM scored"))
def q_polarity_join(spark, sf_dir):
    from ..functions.text import tokenize
    c = comments_view(spark, sf_dir).select("comment_id", tokenize("comment_text").alias("toks"))
    lex = spark.createDataFrame(sorted(POLARITY_LEXICON.items()), "word string, polarity double")
    # fixed lexicon of len(POLARITY_LEXICON) rows: a proven bound for the broadcast
    return SE.polarity_by_join(c, "comment_id", "toks", lex, broadcast_lexicon=True).select(
        "comment_id", _r("polarity"))


@register("most_positive_comments", _scored_cte(
    "SELECT comment_id, post_id, round(polarity, 6) AS polarity FROM scored WHERE polarity >= 0.75"))
def q_most_positive(spark, sf_dir):
    return SE.extreme_comments(_scored(spark, sf_dir), side="positive").select(
        "comment_id", "post_id", _r("polarity"))


@register("most_negative_comments", _scored_cte(
    "SELECT comment_id, post_id, round(polarity, 6) AS polarity FROM scored WHERE polarity <= -0.5"))
def q_most_negative(spark, sf_dir):
    return SE.extreme_comments(_scored(spark, sf_dir), side="negative").select(
        "comment_id", "post_id", _r("polarity"))


# --- J1 wide table -------------------------------------------------------------------

WIDE_COLS = ("post_id", "profile_name", "post_timestamp", "post_text", "is_multiple_pictures", "nbr_likes",
             "nbr_comments", "is_video", "likes_level", "year", "month", "dayofweek", "is_weekend",
             "has_mention", "has_hashtag", "nbr_words", "comments_sentiment", "comments_nbr_mentions",
             "comments_nbr_verified", "comment_positivity")


@register("posts_wide", _wide_cte("SELECT * FROM wide"))
def q_wide(spark, sf_dir):
    return FE.assemble_features(_posts(spark, sf_dir), comments_view(spark, sf_dir)).select(*WIDE_COLS)


@register("comment_positivity_counts", _wide_cte(
    "SELECT comment_positivity, count(*) AS n FROM wide GROUP BY 1"))
def q_positivity(spark, sf_dir):
    w = FE.assemble_features(_posts(spark, sf_dir), comments_view(spark, sf_dir))
    return w.groupBy("comment_positivity").agg(F.count(F.lit(1)).alias("n"))


# --- X1, X3, X7, X9 feature preparation ----------------------------------------------

def _index_sql(col: str) -> str:
    return _posts_cte(f"""WITH cal AS (SELECT CAST({col} AS VARCHAR) AS v
                    FROM (SELECT {S.calendar_cols()} FROM posts) c)
SELECT '{col}' AS feature, v AS value, row_number() OVER (ORDER BY count(*) DESC, v) - 1 AS idx
FROM cal WHERE v IS NOT NULL GROUP BY v""")


def _index_q(col: str):
    def fn(spark, sf_dir):
        from pyspark.ml.feature import StringIndexer
        cal = add_calendar(_posts(spark, sf_dir)).select(F.col(col).cast("string").alias(col))
        labels = StringIndexer(inputCol=col, outputCol="i").fit(cal).labels
        return spark.createDataFrame([(col, v, i) for i, v in enumerate(labels)],
                                     "feature string, value string, idx bigint")
    return fn


for _c in ("year", "month", "dayofweek"):
    register(f"{_c}_index", _index_sql(_c))(_index_q(_c))


@register("mentions_imputed", _wide_cte(
    "SELECT post_id, round(coalesce(comments_nbr_mentions, avg(comments_nbr_mentions) OVER ()), 6) "
    "AS comments_nbr_mentions FROM wide"))
def q_imputed(spark, sf_dir):
    from pyspark.ml.feature import Imputer
    w = FE.assemble_features(_posts(spark, sf_dir), comments_view(spark, sf_dir)).select(
        "post_id", "comments_nbr_mentions")
    imp = Imputer(inputCols=["comments_nbr_mentions"], outputCols=["comments_nbr_mentions"]).fit(w)
    return imp.transform(w).select("post_id", _r("comments_nbr_mentions"))


@register("train_test_split", _posts_cte(
    f"SELECT post_id, CAST({S.split_bucket('post_id')} < 70 AS INTEGER) AS is_train FROM posts"))
def q_split(spark, sf_dir):
    p = _posts(spark, sf_dir)
    return p.select("post_id", (ML.split_bucket("post_id") < 70).cast("int").alias("is_train"))


@register("posts_dummies", None)
def q_dummies(spark, sf_dir):
    # the observed values and the dummies read one narrow copy of the wide table
    w = FE.assemble_features(_posts(spark, sf_dir), comments_view(spark, sf_dir))
    return FE.dummies(cut_lineage(w.select("year", "month", "dayofweek", *DUMMY_KEEP)), keep=DUMMY_KEEP)


@register("posts_dummy_rows", _posts_cte(f"""WITH cal AS (SELECT post_id, {S.calendar_cols()} FROM posts)
SELECT post_id, 'year_' || year AS feature, 1 AS value FROM cal WHERE year IS NOT NULL
UNION ALL SELECT post_id, 'month_' || month, 1 FROM cal WHERE month IS NOT NULL
UNION ALL SELECT post_id, 'dayofweek_' || dayofweek, 1 FROM cal WHERE dayofweek IS NOT NULL"""))
def q_dummy_rows(spark, sf_dir):
    return FE.dummy_rows(add_calendar(_posts(spark, sf_dir)), "post_id")


ONEHOT_COLS = ("year", "month", "dayofweek", "is_multiple_pictures", "is_video")


@register("posts_onehot_rows", _clean_cte("WITH cal AS (SELECT post_id, is_multiple_pictures, is_video, "
    + S.calendar_cols() + " FROM posts_clean),\nlong AS (" + " UNION ALL ".join(
        f"SELECT post_id, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM cal WHERE {c} IS NOT NULL" for c in ONEHOT_COLS) + """),
ranked AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) - 1 AS place,
                  count(*) OVER (PARTITION BY c) AS k FROM long GROUP BY c, v)
SELECT post_id, long.c || '_' || long.v AS feature, CAST(place AS INTEGER) AS place, CAST(1.0 AS DOUBLE) AS value
FROM long JOIN ranked ON long.c = ranked.c AND long.v = ranked.v WHERE place < k - 1"""))
def q_onehot_rows(spark, sf_dir):
    # category counts need no bands: any cut values do
    clean = CL.clean_posts(_posts(spark, sf_dir), cuts=[0, 0])
    return FE.onehot_rows(add_calendar(clean), "post_id", ONEHOT_COLS)


# --- X5 scaling with train-only statistics ------------------------------------------

@register("contfeats_scaled", _wide_cte(f"""WITH
imp0 AS (SELECT post_id, CAST(nbr_words AS DOUBLE) AS nw, comments_nbr_mentions AS cm,
                {S.split_bucket('post_id')} < 70 AS is_train FROM wide),
m AS (SELECT avg(cm) AS mm FROM imp0 WHERE is_train),
imp AS (SELECT post_id, nw, coalesce(cm, mm) AS cm, is_train FROM imp0, m),
sd AS (SELECT stddev_samp(nw) AS s1, stddev_samp(cm) AS s2 FROM imp WHERE is_train)
SELECT post_id, round(CASE WHEN s1 = 0 THEN 0.0 ELSE nw / s1 END, 6) AS nbr_words_scaled,
       round(CASE WHEN s2 = 0 THEN 0.0 ELSE cm / s2 END, 6) AS comments_nbr_mentions_scaled
FROM imp, sd"""))
def q_scaled(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    # the fits and the scaled rows read one narrow copy of the wide table
    wide = FE.assemble_features(_posts(spark, sf_dir), comments_view(spark, sf_dir))
    wide = cut_lineage(wide.select("post_id", *ML.CAT_STR, *ML.CAT_NUM, *ML.CONT, ML.default_outcome("classification")))
    train, test, model = ML.prepare(wide, "classification", with_text=False, checkpoint=False)
    full = model.transform(ML.prepare_input(wide, "classification"))
    arr = vector_to_array("scaled_contfeats")
    return full.select("post_id", F.round(arr[0], 6).alias("nbr_words_scaled"),
                       F.round(arr[1], 6).alias("comments_nbr_mentions_scaled"))


# --- E1-E7 evaluation on a deterministic baseline ---------------------------------------
# Regression baseline: predict a test post's likes by the floored mean likes of
# training posts of the same month (else of all training posts).
# Classification baseline: predict high comment positivity when likes are high.

def _regression_baseline(spark, sf_dir):
    cal = add_calendar(_posts(spark, sf_dir)).select("post_id", "nbr_likes", "month")
    train, test = ML.hash_split(cal)
    # <= 12 rows (one per month): a provably small broadcast
    mm = train.groupBy("month").agg(F.floor(F.avg("nbr_likes")).cast("double").alias("pm"))
    g = train.agg(F.floor(F.avg("nbr_likes")).cast("double")).first()[0]
    return test.join(F.broadcast(mm), "month", "left").select(
        "post_id", F.col("nbr_likes").cast("double").alias("label"),
        F.coalesce(F.col("pm"), F.lit(g)).alias("prediction"))


_REG_PRED_SQL = _posts_cte(f"""WITH
cal AS (SELECT post_id, nbr_likes, CAST(month(post_timestamp) AS INTEGER) AS month,
               {S.split_bucket('post_id')} < 70 AS is_train FROM posts),
mm AS (SELECT month, CAST(floor(avg(nbr_likes)) AS DOUBLE) AS pm FROM cal WHERE is_train GROUP BY month),
gm AS (SELECT CAST(floor(avg(nbr_likes)) AS DOUBLE) AS g FROM cal WHERE is_train),
pred AS (SELECT post_id, CAST(nbr_likes AS DOUBLE) AS label, coalesce(mm.pm, gm.g) AS prediction
         FROM cal LEFT JOIN mm USING (month) CROSS JOIN gm WHERE NOT is_train)
SELECT * FROM pred""")


def _over_pred(pred_sql: str, body: str) -> str:
    """Replace the final SELECT of a prediction CTE chain; a body starting
    with ',' continues the CTE list."""
    return pred_sql.replace("\nSELECT * FROM pred", body if body.startswith(",") else "\n" + body)


@register("regression_metrics_baseline", _over_pred(_REG_PRED_SQL, """
SELECT count(*) AS n, round(avg((label - prediction) * (label - prediction)), 2) AS mse,
       round(sqrt(avg((label - prediction) * (label - prediction))), 4) AS rmse,
       round(avg(abs(label - prediction)), 4) AS mae,
       round(1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)), 6) AS r2
FROM pred"""))
def q_reg_metrics(spark, sf_dir):
    m = EV.regression_metrics(_regression_baseline(spark, sf_dir))
    return m.select("n", _r("mse", 2), _r("rmse", 4), _r("mae", 4), _r("r2"))


@register("residuals_baseline", _over_pred(
    _REG_PRED_SQL, "SELECT post_id, label, prediction, label - prediction AS residual FROM pred"))
def q_residuals(spark, sf_dir):
    return EV.residuals(_regression_baseline(spark, sf_dir))


def _positivity_and_likes(spark, sf_dir):
    """(post_id, nbr_likes, label): label 1.0 where the comments are above the median."""
    posts = _posts(spark, sf_dir).select("post_id", "nbr_likes")
    cf = cut_lineage(FE.comment_features(_scored(spark, sf_dir)).select("post_id", "comments_sentiment"))
    high = CL.binary_by_threshold("comments_sentiment", FE.sentiment_median(cf)) == "high"
    return posts.join(cf, "post_id", "left").select("post_id", "nbr_likes", F.when(high, 1.0).otherwise(0.0).alias("label"))


def _classification_baseline(spark, sf_dir):
    cuts = CL.likes_cuts(_posts(spark, sf_dir))
    level = CL.band_by_quantiles("nbr_likes", cuts) if cuts else F.lit(None).cast("string")
    _, test = ML.hash_split(_positivity_and_likes(spark, sf_dir))
    return test.select("post_id", "label", F.when(level == "high", 1.0).otherwise(0.0).alias("prediction"))


_CLS_PRED_SQL = _wide_cte(f"""WITH
pred AS (SELECT post_id, CASE WHEN comment_positivity = 'high' THEN 1.0 ELSE 0.0 END AS label,
                CASE WHEN likes_level = 'high' THEN 1.0 ELSE 0.0 END AS prediction
         FROM wide WHERE {S.split_bucket('post_id')} >= 70)
SELECT * FROM pred""")


@register("confusion_matrix_baseline", _over_pred(_CLS_PRED_SQL, """
SELECT CAST(label AS DOUBLE) AS label, CAST(count_if(prediction = 0.0) AS BIGINT) AS pred_0,
       CAST(count_if(prediction = 1.0) AS BIGINT) AS pred_1
FROM pred GROUP BY label"""))
def q_confusion(spark, sf_dir):
    return EV.confusion_matrix(_classification_baseline(spark, sf_dir))


@register("confusion_matrix_levels", _clean_cte("""WITH
lv AS (SELECT CAST(CASE likes_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS DOUBLE) AS label,
              CAST(nbr_comments % 4 AS DOUBLE) AS prediction FROM posts_clean
       WHERE likes_level IS NOT NULL AND nbr_comments IS NOT NULL),
cl AS (SELECT label AS c FROM lv UNION SELECT prediction FROM lv),
n AS (SELECT label, prediction, count(*) AS n FROM lv GROUP BY 1, 2)
SELECT a.c AS label, b.c AS prediction, coalesce(n.n, 0) AS n
FROM cl a CROSS JOIN cl b LEFT JOIN n ON n.label = a.c AND n.prediction = b.c"""))
def q_confusion_levels(spark, sf_dir):
    """Three classes of likes against a prediction with a fourth class."""
    clean = CL.clean_posts(_posts(spark, sf_dir)).where("likes_level IS NOT NULL AND nbr_comments IS NOT NULL")
    label = F.when(F.col("likes_level") == "low", 0.0).when(F.col("likes_level") == "medium", 1.0).otherwise(2.0)
    return EV.confusion_counts(clean.select(label.alias("label"),
                                            (F.col("nbr_comments") % 4).cast("double").alias("prediction")))


@register("ranking_baseline", _wide_cte("""WITH
x AS (SELECT CAST(comment_positivity = 'high' AS INTEGER) AS l, nbr_likes AS s FROM wide),
tot AS (SELECT sum(l) AS p, count(*) - sum(l) AS n FROM x),
rk AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x),
auc AS (SELECT (sum(r) FILTER (l = 1) - max(p) * (max(p) + 1) / 2.0) / (max(p) * max(n)) AS auc FROM rk, tot),
th AS (SELECT s, sum(l) AS tp, count(*) AS k FROM x GROUP BY s),
cu AS (SELECT s, sum(tp) OVER (ORDER BY s DESC) AS tp, sum(k) OVER (ORDER BY s DESC) AS k FROM th),
pt AS (SELECT s, tp / p AS rec, tp / k AS prec FROM cu, tot),
sg AS (SELECT rec - coalesce(lag(rec) OVER (ORDER BY s DESC), 0) AS dr,
              prec + coalesce(lag(prec) OVER (ORDER BY s DESC), prec) AS pp FROM pt)
SELECT 'areaUnderROC' AS metric, round(auc, 6) AS value FROM auc
UNION ALL SELECT 'areaUnderPR', round(sum(dr * pp / 2), 6) FROM sg"""))
def q_ranking(spark, sf_dir):
    """E2, E3 on a deterministic score: the likes of a post against its comments' positivity."""
    rows = ML.ranking_metrics(_positivity_and_likes(spark, sf_dir).withColumnRenamed("nbr_likes", "score"))
    return spark.createDataFrame([(m, round(v, 6)) for m, v in rows], "metric string, value double")


NB_FEATURES = ("is_video", "is_multiple_pictures", "has_mention", "has_hashtag")


def _flag_frame(spark, sf_dir):
    clean = CL.clean_posts(_posts(spark, sf_dir))
    return clean.select((F.col("likes_level") == "high").cast("int").alias("c"), "nbr_likes", "nbr_comments", "is_video",
                        "is_multiple_pictures", TX.T.has_mention("post_text").alias("has_mention"),
                        TX.T.has_hashtag("post_text").alias("has_hashtag")).where("c IS NOT NULL")


_FLAG_CTE = f"""fl AS (SELECT CAST(likes_level = 'high' AS INTEGER) AS c, nbr_likes, nbr_comments, is_video,
  is_multiple_pictures, {S.has_sub('post_text', '@')} AS has_mention, {S.has_sub('post_text', '#')} AS has_hashtag
  FROM posts_clean WHERE likes_level IS NOT NULL)"""


@register("naive_bayes_baseline", _clean_cte(f"WITH {_FLAG_CTE},\nlg AS (" + " UNION ALL ".join(
    f"SELECT c, '{f}' AS feature, sum({f}) AS s FROM fl GROUP BY c" for f in NB_FEATURES) + """),
tt AS (SELECT c, sum(s) AS t FROM lg GROUP BY c)
SELECT c AS class, 'prior' AS feature,
       round(ln(count(*) + 1.0) - ln((SELECT count(*) FROM fl) + 2.0), 6) AS log_value FROM fl GROUP BY c
UNION ALL SELECT lg.c, feature, round(ln(s + 1.0) - ln(t + 4.0), 6) FROM lg JOIN tt USING (c)"""))
def q_naive_bayes(spark, sf_dir):
    """The fitted log priors and likelihoods, from counts in SQL."""
    # the fit reads its rows more than once: one narrow copy
    rows, _ = ML.naive_bayes_tables(cut_lineage(_flag_frame(spark, sf_dir)), NB_FEATURES, "c")
    return spark.createDataFrame([(c, f, round(v, 6)) for c, f, v in rows], "class int, feature string, log_value double")


@register("linear_regression_baseline", _clean_cte(f"""WITH {_FLAG_CTE},
m AS (SELECT covar_pop(nbr_comments, nbr_likes) AS c1, covar_pop(is_video, nbr_likes) AS c2, var_pop(nbr_comments) AS v1,
             var_pop(is_video) AS v2, covar_pop(nbr_comments, is_video) AS c12, avg(nbr_likes) AS my,
             avg(nbr_comments) AS m1, avg(is_video) AS m2 FROM fl),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m)
SELECT 'nbr_comments' AS term, round(b1, 3) AS value FROM b UNION ALL SELECT 'is_video', round(b2, 3) FROM b
UNION ALL SELECT 'intercept', round(my - b1 * m1 - b2 * m2, 3) FROM b"""))
def q_linear_regression(spark, sf_dir):
    """L1 without a penalty: the coefficients are those of the normal equations."""
    names = ("nbr_comments", "is_video")
    data = ML.VectorAssembler(inputCols=list(names), outputCol="features").transform(
        _flag_frame(spark, sf_dir).withColumn("label", F.col("nbr_likes").cast("double")))
    model = ML.LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="normal").fit(data)
    rows = [*zip(names, model.coefficients), ("intercept", model.intercept)]
    return spark.createDataFrame([(n, round(float(v), 3)) for n, v in rows], "term string, value double")


@register("tree_root_split", _clean_cte(f"WITH {_FLAG_CTE},\nsp AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(nbr_likes) FILTER ({f} = 0) AS lo, avg(nbr_likes) FILTER ({f} = 1) AS hi, "
    f"count(*) FILTER ({f} = 0) AS n0, count(*) FILTER ({f} = 1) AS n1 FROM fl" for f in NB_FEATURES) + """)
SELECT feature, round(lo, 3) AS left_mean, round(hi, 3) AS right_mean FROM sp WHERE n0 > 0 AND n1 > 0
ORDER BY n0 * n1 * (lo - hi) * (lo - hi) DESC LIMIT 1"""))
def q_tree_root(spark, sf_dir):
    """The root split of the shallow tree is the flag that explains most variance."""
    _, rules = ML.shallow_tree_rules(_flag_frame(spark, sf_dir).select(*NB_FEATURES, "nbr_likes"), "nbr_likes", 1)
    text = "\n".join(r for _, r in rules)
    feature = re.search(r"If \((\w+) <=", text).group(1)
    left, right = (round(float(x), 3) for x in re.findall(r"Predict: ([-0-9.Ee]+)", text))
    return spark.createDataFrame([(feature, left, right)], "feature string, left_mean double, right_mean double")


@register("prediction_counts_baseline", _over_pred(
    _CLS_PRED_SQL, "SELECT CAST(prediction AS DOUBLE) AS prediction, count(*) AS n FROM pred GROUP BY 1"))
def q_pred_counts(spark, sf_dir):
    return EV.prediction_counts(_classification_baseline(spark, sf_dir))


@register("classification_report_baseline", _over_pred(_CLS_PRED_SQL, """,
pairs AS (SELECT label AS l, prediction AS p, count(*) AS n FROM pred GROUP BY 1, 2),
tp AS (SELECT l AS c, n AS tp FROM pairs WHERE l = p),
sup AS (SELECT l AS c, sum(n) AS support FROM pairs GROUP BY 1),
prd AS (SELECT p AS c, sum(n) AS pred_n FROM pairs GROUP BY 1),
per AS (SELECT coalesce(sup.c, prd.c) AS c, coalesce(sup.support, 0) AS support,
               coalesce(prd.pred_n, 0) AS pred_n FROM sup FULL JOIN prd ON sup.c = prd.c),
per2 AS (SELECT per.c, per.support, coalesce(tp.tp, 0) AS tp,
                CASE WHEN pred_n > 0 THEN coalesce(tp.tp, 0) / pred_n ELSE 0.0 END AS precision,
                CASE WHEN support > 0 THEN coalesce(tp.tp, 0) / support ELSE 0.0 END AS recall
         FROM per LEFT JOIN tp ON tp.c = per.c),
per3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                        ELSE 0.0 END AS f1 FROM per2)
SELECT CAST(CAST(c AS DOUBLE) AS VARCHAR) AS class_name, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per3
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per3
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM per3
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM per3"""))
def q_report(spark, sf_dir):
    rep = EV.classification_report(_classification_baseline(spark, sf_dir))
    return rep.select("class_name", _r("precision"), _r("recall"), _r("f1"), "support")


# --- F1-F5, L1-L9, E1-E3 with Spark ML (rows-only: fitted models are not
# bit-stable across partitionings, so values are not compared) ---------------------

_FITTED: dict[tuple, tuple] = {}


def _fitted(spark, sf_dir: str, task: str):
    """Fit once per (session, tables, task) and reuse across the queries that
    report on the same models.  Holds the models and lazy frames of one folder of
    tables at a time, not rows; both tasks read one check-pointed wide table."""
    from .analysis import run_task, shared_wide
    key = (spark.sparkContext.applicationId, sf_dir, task)
    if key not in _FITTED:
        for old in [k for k in _FITTED if k[:2] != key[:2]]:
            del _FITTED[old]
        both = (*key[:2], "wide")
        if both not in _FITTED:
            _FITTED[both] = shared_wide(_posts(spark, sf_dir), comments_view(spark, sf_dir))
        _FITTED[key] = run_task(_FITTED[both], task, folds=5, checkpoint=False)
    return _FITTED[key]


@register("ml_classification_predictions", None)
def q_ml_cls_pred(spark, sf_dir):
    return _fitted(spark, sf_dir, "classification").predictions()


@register("ml_regression_predictions", None)
def q_ml_reg_pred(spark, sf_dir):
    return _fitted(spark, sf_dir, "regression").predictions()


@register("ml_model_report", None)
def q_ml_report(spark, sf_dir):
    """Best hyper-parameters and held-out metrics of every tuned model."""
    rows = []
    for task in ("classification", "regression"):
        res = _fitted(spark, sf_dir, task)
        for m, p, v, score in res.best_params:
            rows.append((task, m, "best_param", p, v, score))
        for m, metric, val in res.metrics:
            rows.append((task, m, "metric", metric, None, val))
        for i, lab in enumerate(res.labels):
            rows.append((task, "label_indexer", "label", str(i), lab, None))
    return spark.createDataFrame(rows, "task string, model string, kind string, name string, "
                                       "value string, score double")


@register("text_feature_vectors", _posts_cte(f"""WITH {_lemmas_sql_cte()}
SELECT post_id, CAST(len(lemmas) AS INTEGER) AS bow_nnz, CAST(len(lemmas) AS DOUBLE) AS tf_sum, 100 AS w2v_size FROM lem"""))
def q_text_vectors(spark, sf_dir):
    """Every distinct lemma is one entry of the bag of words and adds 1 to the hashed counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    tf = cut_lineage(TX.text_features(_posts(spark, sf_dir)).select("post_id", "vector_lemma"))
    # Word2Vec trains in as many tasks as run at once
    tasks = max(4, spark.sparkContext.defaultParallelism)
    model = Pipeline(stages=ML.text_vector_stages(with_w2v=True, w2v_partitions=tasks)).fit(tf)
    # all words, whatever the size of the vocabulary
    bow = TX.tfidf_table(tf, "post_id", "vector_lemma", distinct_words=True).groupBy("post_id").agg(F.count(F.lit(1)).cast("int").alias("_nnz"))
    return model.transform(tf).join(bow, "post_id", "left").select(
        "post_id", F.coalesce("_nnz", F.lit(0)).alias("bow_nnz"),
        F.aggregate(vector_to_array("featuresTF"), F.lit(0.0), lambda a, x: a + x).alias("tf_sum"),
        F.size(vector_to_array("features_w2v")).alias("w2v_size"))


@register("shallow_tree_rules", None)
def q_tree_rules(spark, sf_dir):
    w = FE.assemble_features(_posts(spark, sf_dir), comments_view(spark, sf_dir))
    keep = ["is_multiple_pictures", "is_video", "is_weekend", "has_mention", "has_hashtag", "nbr_words",
            "comments_nbr_mentions", "nbr_likes"]
    d = FE.dummies(w, keep=keep)
    _, rules = ML.shallow_tree_rules(d, "nbr_likes", 3)
    return spark.createDataFrame(rules, "line_no int, rule string")


@register("train_test_sizes", _posts_cte(f"""
SELECT CASE WHEN {S.split_bucket('post_id')} < 70 THEN 'train' ELSE 'test' END AS part, count(*) AS n
FROM posts GROUP BY 1"""))
def q_split_sizes(spark, sf_dir):
    return (_posts(spark, sf_dir).groupBy(ML.split_label("post_id").alias("part"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("post_text_feature_table", _posts_cte(f"""WITH {_lemmas_sql_cte()}
SELECT posts.post_id, {S.has_sub('post_text', '@')} AS has_mention, {S.has_sub('post_text', '#')} AS has_hashtag,
       CAST(len(lemmas) AS INTEGER) AS nbr_words, CAST(len(lemmas) AS DOUBLE) AS tf_sum
FROM posts JOIN lem USING (post_id)"""))
def q_text_table(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    t = ML.text_feature_table(_posts(spark, sf_dir))
    return t.select("post_id", "has_mention", "has_hashtag", "nbr_words",
                    F.aggregate(vector_to_array("featuresTF"), F.lit(0.0), lambda a, x: a + x).alias("tf_sum"))


DUMMY_KEEP = ["is_multiple_pictures", "is_video", "is_weekend", "has_mention", "has_hashtag", "nbr_words",
              "comments_nbr_mentions", "nbr_likes"]


@register("posts_dummy_counts", _wide_cte("""WITH
nn AS (SELECT * FROM wide WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in DUMMY_KEEP) + """)
SELECT 'year_' || year AS dummy, count(*) AS n FROM nn GROUP BY 1
UNION ALL SELECT 'month_' || month, count(*) FROM nn GROUP BY 1
UNION ALL SELECT 'dayofweek_' || dayofweek, count(*) FROM nn GROUP BY 1
UNION ALL SELECT '_rows', count(*) FROM nn"""))
def q_dummy_counts(spark, sf_dir):
    """Column sums of the dummies table (one row per dummy column) plus its
    row count: checks the one-hot columns and the null-row drop."""
    w = FE.assemble_features(_posts(spark, sf_dir), comments_view(spark, sf_dir))
    d = FE.dummies(w, keep=DUMMY_KEEP)
    dummy_cols = [c for c in d.columns if c not in DUMMY_KEEP]
    sums = d.agg(*[F.sum(c).cast("bigint").alias(c) for c in dummy_cols], F.count(F.lit(1)).alias("_rows"))
    pairs = [F.struct(F.lit(c).alias("dummy"), F.col(c).alias("n")) for c in dummy_cols + ["_rows"]]
    return sums.select(F.inline(F.array(*pairs))).where(F.col("n") > 0)


# --- ML coverage: the deterministic part of the model outputs, SQL-checked --------
# Every tuned model predicts every held-out post; held-out labels are the label
# indexer's (fitted on the training split, most frequent class first) for
# classification and the like counts for regression.

@register("ml_classification_coverage", _wide_cte(f"""WITH
sp AS (SELECT comment_positivity AS v, {S.split_bucket('post_id')} < 70 AS is_train FROM wide),
idx AS (SELECT v, CAST(row_number() OVER (ORDER BY count(*) DESC, v) - 1 AS DOUBLE) AS label
        FROM sp WHERE is_train GROUP BY v),
te AS (SELECT idx.label FROM sp JOIN idx USING (v) WHERE NOT sp.is_train),
m AS (SELECT * FROM (VALUES ('dt'), ('rf'), ('nb')) t(model))
SELECT m.model, te.label, count(*) AS n FROM te CROSS JOIN m GROUP BY 1, 2"""))
def q_ml_cls_cov(spark, sf_dir):
    pred = _fitted(spark, sf_dir, "classification").predictions()
    return pred.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))


@register("ml_regression_coverage", _posts_cte(f"""WITH
te AS (SELECT CAST(nbr_likes AS DOUBLE) AS label FROM posts WHERE {S.split_bucket('post_id')} >= 70),
m AS (SELECT * FROM (VALUES ('lr'), ('rfreg')) t(model))
SELECT m.model, count(*) AS n, round(sum(te.label), 1) AS label_sum FROM te CROSS JOIN m GROUP BY 1"""))
def q_ml_reg_cov(spark, sf_dir):
    pred = _fitted(spark, sf_dir, "regression").predictions()
    return pred.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("label"), 1).alias("label_sum"))


from . import catalog_sentiment, catalog_tuning, catalog_words  # noqa: E402, F401  (register further queries)
