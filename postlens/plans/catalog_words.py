"""Registered queries of vocabulary normalisation (T7, T8, N1): Porter stems and verb bases worked
out once per distinct word and joined back.  The oracle spells out the stemmer's steps on its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import wordvec as WV
from ..session import checkpoint_root, cut_lineage
from ..sources.sinks import write_bucketed
from . import sqlgen as S
from .catalog import FE, TX, WIDE_COLS, _posts, _posts_cte, _scored, _verb_base_sql, _wide_cte, register

_WORDS = S.remove_stop(S.tokens(S.clean_text("post_text")))


def _m(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[aeiouy]+[^aeiouy]+'))"


def _short(x: str) -> str:
    return f"regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$')"


def _endings(rules: str, least: int, extra: str = "") -> str:
    """CASE over endings given as 'ending:replacement', longest first."""
    pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
    return "CASE " + " ".join(
        f"WHEN ends_with(w, '{e}') THEN CASE WHEN {_m(f'left(w, -{len(e)})')} > {least}"
        f"{extra if e == 'ion' else ''} THEN left(w, -{len(e)}) || '{to}' ELSE w END" for e, to in pairs) + " ELSE w END"


_TWO = ("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
        "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble")
_THREE = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_FOUR = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"
_STEMS = f"""
vo AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM posts),
p0 AS (SELECT word, regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM vo WHERE length(word) > 2),
p1 AS (SELECT word, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, -2) WHEN ends_with(w, 'ss') THEN w
       WHEN ends_with(w, 's') THEN left(w, -1) ELSE w END AS w FROM p0),
p2 AS (SELECT word, w, CASE WHEN ends_with(w, 'eed') THEN 'eed'
       WHEN ends_with(w, 'ed') AND regexp_matches(left(w, -2), '[aeiouy]') THEN 'ed'
       WHEN ends_with(w, 'ing') AND regexp_matches(left(w, -3), '[aeiouy]') THEN 'ing' ELSE '' END AS c FROM p1),
p3 AS (SELECT word, c, CASE WHEN c = 'eed' THEN CASE WHEN {_m('left(w, -3)')} > 0 THEN left(w, -1) ELSE w END
       WHEN c = '' THEN w ELSE left(w, -length(c)) END AS w FROM p2),
p4 AS (SELECT word, CASE WHEN c NOT IN ('ed', 'ing') THEN w
       WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e'
       WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND NOT regexp_matches(w, '[aeiouylsz]$') THEN left(w, -1)
       WHEN {_m('w')} = 1 AND {_short('w')} THEN w || 'e' ELSE w END AS w FROM p3),
p5 AS (SELECT word, CASE WHEN lower(right(w, 1)) = 'y' AND regexp_matches(left(w, -1), '[aeiouy]') THEN left(w, -1) || 'i' ELSE w END AS w FROM p4),
p6 AS (SELECT word, {_endings(_TWO, 0)} AS w FROM p5),
p7 AS (SELECT word, {_endings(_THREE, 0)} AS w FROM p6),
p8 AS (SELECT word, {_endings(_FOUR, 1, " AND regexp_matches(left(w, -3), '[st]$')")} AS w FROM p7),
p9 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({_m('left(w, -1)')} > 1 OR ({_m('left(w, -1)')} = 1 AND NOT {_short('left(w, -1)')}))
       THEN left(w, -1) ELSE w END AS w FROM p8),
st AS (SELECT word, lower(CASE WHEN ends_with(w, 'll') AND {_m('w')} > 1 THEN left(w, -1) ELSE w END) AS stem FROM p9
       UNION ALL SELECT word, word FROM vo WHERE length(word) <= 2)"""


@register("vocabulary_stems", _posts_cte(f"""WITH {_STEMS}
SELECT st.word, n_rows, stem FROM st JOIN (SELECT word, count(*) AS n_rows FROM
  (SELECT unnest(list_distinct({_WORDS})) AS word FROM posts) u GROUP BY word) n USING (word)"""))
def q_vocabulary_stems(spark, sf_dir):
    """Porter's stem of every distinct word of the posts."""
    return TX.vocabulary_stems(TX.text_features(_posts(spark, sf_dir)), "text_words_f")


@register("stems_normalised", _posts_cte(f"""WITH {_STEMS},
tk AS (SELECT post_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT post_id, {_WORDS} AS w FROM posts))
SELECT posts.post_id, coalesce(string_agg(stem, ' ' ORDER BY pos) FILTER (length(stem) >= 3), '') AS stems
FROM posts LEFT JOIN tk USING (post_id) LEFT JOIN st USING (word) GROUP BY posts.post_id"""))
def q_stems_normalised(spark, sf_dir):
    """The posts' tokens as Porter stems, in order, by way of the vocabulary."""
    tf = TX.text_features_normalised(_posts(spark, sf_dir))
    return tf.select("post_id", F.array_join("vector_stemmed", " ").alias("stems"))


_LEMMAS = f"""lem AS (SELECT post_id, list_sort(list_distinct(list_transform(
  list_filter({_WORDS}, lambda x: NOT list_contains({S.lst(S.BAD_TOKENS)}, x)), lambda w: {_verb_base_sql('w')}))) AS lemmas FROM posts)"""


@register("post_text_normalised", _posts_cte(f"""WITH {_LEMMAS}
SELECT posts.post_id, {S.has_sub('post_text', '@')} AS has_mention, {S.has_sub('post_text', '#')} AS has_hashtag,
       CAST(len(lemmas) AS INTEGER) AS nbr_words, array_to_string(lemmas, ' ') AS vector_lemma FROM posts JOIN lem USING (post_id)"""))
def q_post_text_normalised(spark, sf_dir):
    """Distinct base forms of each post, regular verbs reduced too."""
    tf = TX.text_features_normalised(_posts(spark, sf_dir))
    return tf.select("post_id", "has_mention", "has_hashtag", "nbr_words", F.array_join("vector_lemma", " ").alias("vector_lemma"))


@register("post_top_words_normalised", _posts_cte(f"""WITH {_LEMMAS}
SELECT trim(lower(w)) AS post_word, count(*) AS count FROM (SELECT unnest(lemmas) AS w FROM lem) u
WHERE length(w) > 0 GROUP BY 1 ORDER BY count DESC, post_word LIMIT 25"""))
def q_top_words_normalised(spark, sf_dir):
    """The 25 base forms that most posts hold."""
    tf = TX.text_features_normalised(_posts(spark, sf_dir))
    return TX.word_frequency(tf, "vector_lemma", "post_word", top_k=25)


# --- F1, X1: dictionary encoding; T10, O3: sketch; J1, S8: co-partitioned tables ------------------

@register("bow_rows", _posts_cte(f"""WITH tk AS (SELECT post_id, unnest({_WORDS}) AS word FROM posts),
ids AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS word_id FROM tk GROUP BY word)
SELECT post_id, word_id, count(*) AS n FROM tk JOIN ids USING (word) GROUP BY ALL"""))
def q_bow_rows(spark, sf_dir):
    """Bag of words in long form, over ids by falling frequency."""
    words = cut_lineage(TX.text_features(_posts(spark, sf_dir)).select("post_id", "text_words_f"))
    return TX.bag_of_words(words, "post_id", "text_words_f", TX.word_ids(words, "text_words_f"))


@register("post_top_words_sketch", _posts_cte(f"""
SELECT trim(lower(w)) AS post_word, count(*) AS count
FROM (SELECT unnest(list_distinct({S.lemmatise(_WORDS)})) AS w FROM posts) u WHERE length(w) > 0 GROUP BY 1
ORDER BY count DESC, post_word LIMIT 25"""))
def q_top_words_sketch(spark, sf_dir):
    """The 25 words that most posts hold, by a frequent-items sketch and an exact second pass."""
    return TX.top_words(TX.text_features(_posts(spark, sf_dir)), "vector_lemma", 25, "post_word")


@register("posts_wide_bucketed", _wide_cte("SELECT * FROM wide"))
def q_wide_bucketed(spark, sf_dir):
    """The wide table from posts and per-post comment features bucketed by post_id."""
    name, root, buckets = uuid.uuid4().hex, checkpoint_root(spark).rstrip("/"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts, rollup = (write_bucketed(df, f"{kind}_{name}", f"{root}/tables/{kind}-{name}", "post_id", buckets) for kind, df in (
        ("posts", _posts(spark, sf_dir)), ("rollup", FE.comment_features(_scored(spark, sf_dir)))))
    return FE.assemble_features(posts, None, rollup=rollup).select(*WIDE_COLS)


# --- F4: co-occurrence table of the word vectors -------------------------------------------------

WINDOW, MIN_COUNT = 3, 20


@register("word_ppmi", _posts_cte(f"""WITH ps AS (SELECT post_id, {_WORDS} AS w FROM posts),
tk AS (SELECT post_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM ps),
kn AS (SELECT word FROM tk GROUP BY word HAVING count(*) >= {MIN_COUNT}),
co AS (SELECT a.word, b.word AS context, count(*) AS n FROM tk a JOIN tk b ON a.post_id = b.post_id
       AND b.pos BETWEEN a.pos - {WINDOW} AND a.pos + {WINDOW} AND a.pos <> b.pos
       WHERE a.word IN (SELECT word FROM kn) AND b.word IN (SELECT word FROM kn) GROUP BY ALL),
mg AS (SELECT word, sum(n) AS k FROM co GROUP BY word), tt AS (SELECT sum(n) AS t FROM co)
SELECT co.word, co.context, round(ln(n * t / (x.k * y.k)), 6) AS value
FROM co JOIN mg x ON x.word = co.word JOIN mg y ON y.word = co.context, tt WHERE CAST(n AS DOUBLE) * t > CAST(x.k AS DOUBLE) * y.k"""))
def q_word_ppmi(spark, sf_dir):
    """positive pointwise mutual information of neighbouring words, what the word vectors factorise."""
    return WV.named(*_ppmi(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _ppmi(spark, sf_dir):
    """(the table by word id, the words' ids)."""
    counts, ids = WV.cooccurrence_ids(TX.text_features(_posts(spark, sf_dir)), "text_words_f", WINDOW, MIN_COUNT)
    return WV.ppmi(cut_lineage(counts)), ids


@register("word_vectors", None)
def q_word_vectors(spark, sf_dir):
    """vectors of the posts' words, the leading eigenvectors of the same table."""
    table, ids = _ppmi(spark, sf_dir)
    return WV.word_vectors(table, size=16, rounds=3, ids=ids)[0]
