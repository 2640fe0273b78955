"""Registered queries of the polarity scan, the induced lexicon (M1) and the resampled
intervals (P8), with DuckDB oracles that state the rules on their own."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import polarity as PO
from ..operators.timing import add_calendar
from . import sqlgen as S
from .catalog import PR, SE, _posts, _posts_cte, _r, _scored, _scored_cte, comments_view, recursive, register, with_views

#: Endings that the scan's comments get by comment_id % 8; the invented texts negate nothing.
SCAN_PHRASES = (" not good", " very bad", " not very good", " isn't really awful", " good",
                " never a nice day, not the best one", " REALLY not a bad idea, but so boring", " no it was not so great")

_EVENTS = f"""ph AS (SELECT comment_id, regexp_replace(lower(coalesce(comment_text, '') || ({S.lst(SCAN_PHRASES)})[comment_id % 8 + 1]),
         'n[''’]t\\b', ' not ', 'g') AS t FROM comments),
tk AS (SELECT comment_id, list_filter(regexp_split_to_array(t, '\\W'), lambda x: length(x) > 0) AS w FROM ph),
tok AS (SELECT comment_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos FROM tk),
mk AS (SELECT comment_id, pos, ({S.smap(SE.POLARITY_LEXICON)})[w] AS p, ({S.smap(PO.DEGREE_WORDS)})[w] AS d,
              w IN ('cannot', 'neither', 'no', 'nor', 'not', 'without') AS ng FROM tok),
ev AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY pos) AS e,
              pos - lag(pos, 1, 0) OVER (PARTITION BY comment_id ORDER BY pos) - 1 AS gap
       FROM mk WHERE p IS NOT NULL OR d IS NOT NULL OR ng)"""


@register("comment_polarity_scan", recursive(with_views(f"""WITH {_EVENTS},
st(comment_id, e, total, n, mult, flip, rem) AS (
  SELECT comment_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0, CAST(1 AS DOUBLE), false, CAST(0 AS BIGINT) FROM tk
  UNION ALL
  SELECT comment_id, e,
    total + CASE WHEN p IS NULL THEN 0 WHEN f THEN greatest(-1, least(1, -0.5 * p / m)) ELSE greatest(-1, least(1, p * m)) END,
    n + CAST(p IS NOT NULL AS INTEGER),
    CASE WHEN p IS NOT NULL THEN 1 WHEN d IS NOT NULL THEN m * d ELSE m END,
    CASE WHEN p IS NOT NULL THEN false WHEN d IS NOT NULL THEN f ELSE NOT f END,
    CASE WHEN p IS NOT NULL THEN 0 WHEN d IS NOT NULL THEN r ELSE 3 END
  FROM (SELECT st.comment_id, ev.e, total, n, p, d, CASE WHEN gap > 0 THEN 1 ELSE mult END AS m,
               flip AND rem > gap AS f, greatest(rem - gap, 0) AS r
        FROM st JOIN ev ON ev.comment_id = st.comment_id AND ev.e = st.e + 1) x),
fin AS (SELECT comment_id, arg_max(total, e) AS total, arg_max(n, e) AS n FROM st GROUP BY comment_id),
pol AS (SELECT comment_id, round(CASE WHEN n > 0 THEN total / n ELSE 0 END, 6) AS polarity FROM fin)
SELECT comment_id, polarity, {S.label('polarity')} AS label FROM pol""", posts=False)))
def q_polarity_scan(spark, sf_dir):
    """M1: polarity with pending negations and degree words, of comments that end in such phrases."""
    phrase = F.element_at(F.array(*map(F.lit, SCAN_PHRASES)), (F.col("comment_id") % 8 + 1).cast("int"))
    text = F.concat(F.coalesce("comment_text", F.lit("")), phrase)
    scored = comments_view(spark, sf_dir).select("comment_id", PO.scan_tokens(text).alias("tokens")) \
        .select("comment_id", F.round(PO.polarity_scan("tokens"), 6).alias("polarity"))
    return scored.withColumn("label", SE.sentiment_label("polarity"))


_LEXICON_CTES = """
wd AS (SELECT sentiment_emoji AS s, unnest(list_distinct(comment_words_f)) AS word FROM scored),
ct AS (SELECT word, count(*) AS n, count(*) FILTER (s = 1) AS np, count(*) FILTER (s = -1) AS nn FROM wd GROUP BY word),
tt AS (SELECT sum(n) AS t, sum(np) AS tp, sum(nn) AS tn FROM ct),
lo AS (SELECT word, np, nn, 100.0 * n / t AS a, tp, tn, n FROM ct, tt WHERE n >= 5),
dl AS (SELECT word, np, nn, ln((np + a) / (tp + 100.0 - np - a)) - ln((nn + a) / (tn + 100.0 - nn - a)) AS d,
              sqrt(1 / (np + a) + 1 / (nn + a)) AS sd FROM lo),
lex AS (SELECT word, np, nn, d, d / sd AS z, (exp(d) - 1) / (exp(d) + 1) AS polarity FROM dl WHERE abs(d / sd) >= 1.96)"""


@register("induced_lexicon", _scored_cte("""
SELECT word, np AS n_positive, nn AS n_negative, round(d, 6) AS log_odds, round(z, 6) AS z, round(polarity, 6) AS polarity FROM lex""",
                                         extra_ctes=_LEXICON_CTES))
def q_induced_lexicon(spark, sf_dir):
    """M1: word polarities learnt from the emoji signs of the comments."""
    return PO.induced_lexicon(_scored(spark, sf_dir)).select(
        "word", "n_positive", "n_negative", _r("log_odds"), _r("z"), _r("polarity"))


@register("comment_polarity_induced", _scored_cte("""
SELECT comment_id, round(coalesce(avg(lex.polarity), 0.0), 6) AS polarity
FROM (SELECT comment_id, unnest(CASE WHEN len(comment_words_f) > 0 THEN comment_words_f ELSE [NULL] END) AS word FROM scored) w
LEFT JOIN lex USING (word) GROUP BY comment_id""", extra_ctes=_LEXICON_CTES))
def q_polarity_induced(spark, sf_dir):
    """M1: polarity of the comments under the lexicon learnt from them."""
    scored = _scored(spark, sf_dir)
    words = scored.select("comment_id", F.col("comment_words_f").alias("words"))
    return SE.polarity_by_join(words, "comment_id", "words", PO.induced_lexicon(scored)).select("comment_id", _r("polarity"))


REPLICATES = 200


def _bootstrap_sql(y: str) -> str:
    cuts = [math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2 ** 20) for k in range(9)]
    weight = " ".join(f"WHEN u < {c} THEN {k}" for k, c in enumerate(cuts) if c < 2 ** 20 - 1)
    top = sum(c < 2 ** 20 - 1 for c in cuts)
    parts = " UNION ALL ".join(f"SELECT post_id, '{d}' AS dimension, CAST({d} AS BIGINT) AS value, {y} AS y FROM cal WHERE {y} IS NOT NULL"
                               for d in ("year", "month", "dayofweek", "hour"))
    return _posts_cte(f"""WITH cal AS (SELECT *, {S.calendar_cols()} FROM posts),
long AS ({parts}),
dr AS (SELECT post_id, b, CAST('0x' || substr(md5('0:' || (b // 6) || ':' || post_id), 5 * (b % 6) + 1, 5) AS BIGINT) AS u
       FROM (SELECT DISTINCT post_id FROM cal) p, range({REPLICATES}) r(b)),
wt AS (SELECT post_id, b, CASE {weight} ELSE {top} END AS w FROM dr),
rp AS (SELECT dimension, value, b, sum(w * y) / sum(w) AS m FROM long JOIN wt USING (post_id) GROUP BY ALL HAVING sum(w) > 0),
ci AS (SELECT dimension, value, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rp GROUP BY ALL),
mn AS (SELECT dimension, value, count(*) AS n, avg(y) AS mean FROM long GROUP BY ALL)
SELECT mn.dimension, mn.value, n, round(mean, 6) AS mean, round(lo, 4) AS ci_lo, round(hi, 4) AS ci_hi
FROM mn LEFT JOIN ci ON ci.dimension = mn.dimension AND ci.value IS NOT DISTINCT FROM mn.value""")


@register("likes_by_calendar_bootstrap", _bootstrap_sql("nbr_likes"))
def q_likes_bootstrap(spark, sf_dir):
    """Mean likes by calendar column with intervals resampled by hashed Poisson weights."""
    cal = add_calendar(_posts(spark, sf_dir))
    out = PR.bootstrap_mean_by(cal, ["year", "month", "dayofweek", "hour"], "nbr_likes", "post_id", REPLICATES)
    return out.select("dimension", "value", "n", _r("mean"), _r("ci_lo", 4), _r("ci_hi", 4))
