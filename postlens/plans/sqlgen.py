"""DuckDB spellings of the library's column functions, for the oracle SQL.

Each helper states one function of ``postlens.functions`` anew and takes/returns
SQL expression text.  Only the fixed word and symbol lists are shared.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from ..functions.lexicons import (BAD_TOKENS, EMOJI_RANGES, NEGATIVE_SYMBOLS, POLARITY_LEXICON,
                                  POSITIVE_SYMBOLS, STOP_WORDS_EN, VERB_LEMMAS)

# Spelled out again, not imported: a wrong pattern or rule in the library must not
# be repeated here.
DIGITS = "[0-9]+"
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
# (step, ending, what must stand before it as RE2, what the ending becomes)
STEMS = (
    ("1a", "sses", "", "ss"), ("1a", "ies", "", "i"), ("1a", "s", "[^s]", ""),
    ("1b", "eed", "[aeiouy].*", "ee"), ("1b", "ed", "[aeiouy].*", ""), ("1b", "ing", "[aeiouy].*", ""),
    ("1c", "y", "[aeiouy].+", "i"),
    ("2", "ational", "", "ate"), ("2", "tional", "", "tion"), ("2", "ization", "", "ize"), ("2", "iveness", "", "ive"),
    ("2", "fulness", "", "ful"), ("2", "ousness", "", "ous"),
    ("3", "icate", "", "ic"), ("3", "alize", "", "al"), ("3", "ness", "", ""),
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs: Iterable[str]) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def smap(d: Mapping[str, object]) -> str:
    def v(x):
        return q(x) if isinstance(x, str) else repr(float(x))
    return "MAP {" + ", ".join(f"{q(k)}: {v(x)}" for k, x in sorted(d.items())) + "}"


def empty(t: str) -> str:
    return f"coalesce({t}, '')"


def clean_text(t: str) -> str:
    return (f"regexp_replace(regexp_replace({empty(t)}, '{DIGITS}', '', 'g'), "
            f"'{PUNCT_CLASS}', '', 'g')")


def count_sub(t: str, s: str) -> str:
    e = empty(t)
    return f"CAST((length({e}) - length(replace({e}, {q(s)}, ''))) / {len(s)} AS INTEGER)"


def has_sub(t: str, s: str) -> str:
    return f"CAST(contains({empty(t)}, {q(s)}) AS INTEGER)"


def tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({empty(t)}), '\\W'), lambda x: length(x) > 0)"


def remove_stop(toks: str) -> str:
    return f"list_filter({toks}, lambda x: NOT list_contains({lst(sorted(set(STOP_WORDS_EN)))}, lower(x)))"


def lemmatise(toks: str) -> str:
    kept = f"list_filter({toks}, lambda x: NOT list_contains({lst(BAD_TOKENS)}, x))"
    return (f"list_sort(list_distinct(list_transform({kept}, "
            f"lambda x: coalesce(({smap(VERB_LEMMAS)})[x], x))))")


def stem_step(x: str, step: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {q(before + end + '$')}) THEN left({x}, -{len(end)}) || {q(to)}"
                     for s, end, before, to in STEMS if s == step)
    return f"(CASE {whens} ELSE {x} END)"


def stem_tokens(toks: str, min_len: int = 3) -> str:
    out = toks
    for step in ("1a", "1b", "1c", "2", "3"):
        out = f"list_transform({out}, lambda w: {stem_step('w', step)})"
    return f"list_filter({out}, lambda s: length(s) >= {min_len})"


def polarity(toks: str, lexicon: Mapping[str, float] = POLARITY_LEXICON) -> str:
    hits = f"list_filter(list_transform({toks}, lambda w: ({smap(lexicon)})[w]), lambda v: v IS NOT NULL)"
    return (f"(CASE WHEN len({hits}) = 0 THEN 0.0 "
            f"ELSE list_reduce(list_prepend(0.0, {hits}), lambda a, b: a + b) / len({hits}) END)")


def label(p: str) -> str:
    return f"(CASE WHEN {p} > 0.1 THEN 1 WHEN {p} < -0.1 THEN -1 ELSE 0 END)"


def verified(c: str) -> str:
    return (f"(CASE WHEN {c} = 'True' THEN 1 WHEN TRY_CAST({c} AS DOUBLE) = 1.0 THEN 1 "
            f"WHEN {c} = 'False' THEN 0 WHEN TRY_CAST({c} AS DOUBLE) = 0.0 THEN 0 "
            f"WHEN {c} = 'Not found' THEN 0 WHEN {c} IS NULL THEN 0 END)")


def emojis(t: str) -> str:
    one = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in EMOJI_RANGES)
    return f"regexp_extract_all({empty(t)}, '[{one}]')"


def any_contains(t: str, symbols: Iterable[str]) -> str:
    syms = list(dict.fromkeys(symbols))
    return "(" + " OR ".join(f"contains({t}, {q(s)})" for s in syms) + ")"


def emoji_sentiment(t: str) -> str:
    e = empty(t)
    return (f"(CASE WHEN {any_contains(e, POSITIVE_SYMBOLS)} THEN 1 "
            f"WHEN {any_contains(e, NEGATIVE_SYMBOLS)} THEN -1 ELSE 0 END)")


def overall(se: str, lab: str) -> str:
    return (f"(CASE WHEN {se} = 1 THEN 1 WHEN {se} = -1 THEN -1 WHEN {lab} = -1 THEN -1 "
            f"WHEN {lab} = 1 THEN 1 ELSE 0 END)")


# Scored comments as a CTE body over the `comments` CTE.
SCORED_SQL = f"""
SELECT s2.*, {overall('sentiment_emoji', 'label')} AS overall_sentiment
FROM (
  SELECT s1.*, {label('polarity')} AS label
  FROM (
    SELECT comment_id, commenter_id, commenter_verified, post_id, comment_text,
           {count_sub('comment_text', '@')} AS nbr_mentions,
           {verified('commenter_verified')} AS is_verified_author,
           {remove_stop(tokens(clean_text('comment_text')))} AS comment_words_f,
           {tokens('comment_text')} AS raw_tokens,
           {polarity(tokens('comment_text'))} AS polarity,
           {emojis('comment_text')} AS emojis,
           {emoji_sentiment('comment_text')} AS sentiment_emoji
    FROM comments
  ) s1
) s2
"""

COMMENT_FEATURES_SQL = """
SELECT post_id,
       AVG(overall_sentiment) AS comments_sentiment,
       CAST(SUM(nbr_mentions) AS BIGINT) AS comments_nbr_mentions,
       CAST(SUM(is_verified_author) AS BIGINT) AS comments_nbr_verified
FROM scored
WHERE post_id IS NOT NULL
GROUP BY post_id
"""


def split_bucket(id_expr: str, seed: int = 72584) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({id_expr} AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"


# posts_clean over the `posts` CTE (likes banded by exact 30/60% quantiles)
POSTS_CLEAN_CTES = """
likes_q AS (SELECT quantile_disc(nbr_likes, 0.3) AS q0, quantile_disc(nbr_likes, 0.6) AS q1 FROM posts),
posts_clean AS (
  SELECT post_id, profile_name, post_timestamp, post_text,
         CAST(is_multiple_pictures AS INTEGER) AS is_multiple_pictures, nbr_likes, nbr_comments,
         CAST(replace(is_video, chr(13), '') = 'True' AS INTEGER) AS is_video,
         CASE WHEN nbr_likes < q0 THEN 'low' WHEN nbr_likes < q1 THEN 'medium'
              WHEN nbr_likes >= q1 THEN 'high' END AS likes_level
  FROM posts, likes_q)
"""


def calendar_cols(ts: str = "post_timestamp") -> str:
    return (f"CAST(year({ts}) AS INTEGER) AS year, CAST(month({ts}) AS INTEGER) AS month, "
            f"CAST(dayofweek({ts}) + 1 AS INTEGER) AS dayofweek, CAST(hour({ts}) AS INTEGER) AS hour, "
            f"CAST(CASE WHEN {ts} IS NULL THEN NULL WHEN dayofweek({ts}) + 1 IN (6, 7) THEN 1.0 ELSE 0.0 END "
            f"AS DOUBLE) AS is_weekend")


def post_text_cols(t: str = "post_text") -> str:
    words_f = remove_stop(tokens(clean_text(t)))
    return (f"{has_sub(t, '@')} AS has_mention, {has_sub(t, '#')} AS has_hashtag, "
            f"CAST(len({lemmatise(words_f)}) AS INTEGER) AS nbr_words")


# wide table over posts, comments (needs scored, posts_clean CTEs)
WIDE_CTES = f"""
cf AS ({COMMENT_FEATURES_SQL}),
med AS (SELECT quantile_disc(comments_sentiment, 0.5) AS m FROM cf),
wide AS (
  SELECT pc.post_id, pc.profile_name, pc.post_timestamp, pc.post_text, pc.is_multiple_pictures,
         pc.nbr_likes, pc.nbr_comments, pc.is_video, pc.likes_level,
         CAST(CAST(year(pc.post_timestamp) AS INTEGER) AS VARCHAR) AS year,
         CAST(CAST(month(pc.post_timestamp) AS INTEGER) AS VARCHAR) AS month,
         CAST(CAST(dayofweek(pc.post_timestamp) + 1 AS INTEGER) AS VARCHAR) AS dayofweek,
         CAST(CASE WHEN dayofweek(pc.post_timestamp) + 1 IN (6, 7) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS is_weekend,
         {post_text_cols('pc.post_text')},
         cf.comments_sentiment, CAST(cf.comments_nbr_mentions AS DOUBLE) AS comments_nbr_mentions,
         cf.comments_nbr_verified,
         CASE WHEN cf.comments_sentiment > med.m THEN 'high' ELSE 'low' END AS comment_positivity
  FROM posts_clean pc LEFT JOIN cf ON cf.post_id = pc.post_id CROSS JOIN med)
"""
