"""Comment scoring: flags, mentions, tokens, lexicon polarity, emoji and
overall sentiment, all as native columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emoji as E
from ..functions import text as T
from ..functions.flags import normalise_flag
from ..functions.lexicons import NEGATIVE_SYMBOLS, POLARITY_LEXICON, POSITIVE_SYMBOLS
from .text import join_by_word

POSITIVE_CUT, NEGATIVE_CUT = 0.1, -0.1


def polarity_expr(tokens: Column | str, lexicon: Mapping[str, float] = POLARITY_LEXICON) -> Column:
    """Mean polarity of the tokens found in a bounded lexicon, 0.0 without a
    hit.  Row-local (map literal lookup inside the array), no shuffle."""
    m = T._map_literal({k: float(v) for k, v in lexicon.items()})
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    # hash-set membership first; the map, whose lookup scans its keys, is probed for hits only
    hits = F.transform(F.filter(t, lambda w: w.isin(*sorted(lexicon))), lambda w: F.element_at(m, w))
    total = F.aggregate(hits, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(hits) == 0, F.lit(0.0)).otherwise(total / F.size(hits))


def polarity_by_join(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame,
                     word_col: str = "word", value_col: str = "polarity",
                     out_col: str = "polarity", broadcast_lexicon: bool = False) -> DataFrame:
    """Polarity for lexicons given as a table of any size: tokens join the
    lexicon (salted by the id, so a frequent word is dealt over many tasks),
    average per id, left-joined back; 0.0 without a hit.  Several rows for one
    word count as their mean.  ``id_col`` must be unique.
    ``broadcast_lexicon`` forces the broadcast; set it only for a lexicon of
    known bounded size whose statistics the planner lacks."""
    lex = lexicon.select(F.col(word_col).alias("_w"), F.col(value_col).cast("double").alias("_p")) \
                 .groupBy("_w").agg(F.avg("_p").alias("_p"))
    gen, keep = T.explode_values(tokens_col, "_w")
    toks = df.select(id_col, gen).where(keep)
    hits = toks.join(F.broadcast(lex), "_w") if broadcast_lexicon else join_by_word(toks, lex, "_w", id_col)
    per = (hits.groupBy(id_col).agg(F.avg("_p").alias(out_col)))
    return (df.join(per, id_col, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0.0))))


def sentiment_label(p: Column | str, pos_cut: float = POSITIVE_CUT, neg_cut: float = NEGATIVE_CUT) -> Column:
    """> pos_cut -> 1, < neg_cut -> -1, else (including null) 0."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > pos_cut, F.lit(1)).when(p < neg_cut, F.lit(-1)).otherwise(F.lit(0))


def overall_sentiment(emoji_sign: Column | str, label: Column | str) -> Column:
    """The emoji sign wins; else the text label; else 0."""
    e = F.col(emoji_sign) if isinstance(emoji_sign, str) else emoji_sign
    lab = F.col(label) if isinstance(label, str) else label
    return (F.when(e == 1, F.lit(1)).when(e == -1, F.lit(-1))
            .when(lab == -1, F.lit(-1)).when(lab == 1, F.lit(1)).otherwise(F.lit(0)))


def score_comments(comments: DataFrame, text_col: str = "comment_text",
                   lexicon: Mapping[str, float] = POLARITY_LEXICON,
                   positive: Iterable[str] = POSITIVE_SYMBOLS,
                   negative: Iterable[str] = NEGATIVE_SYMBOLS,
                   symbol_mode: str = "substring", unicode: bool = False) -> DataFrame:
    """Add every per-comment feature.  Row-local: one projection, no shuffle.

    Columns added: comment_str_only, nbr_mentions, is_verified_author,
    comment_words, comment_words_f, polarity, label, emojis, emojis_count,
    unique_emoji, sentiment_emoji, overall_sentiment.  Null text reads as ''.
    """
    positive, negative = list(positive), list(negative)
    # three projections in dependency order (one analysis each, instead of
    # one per column); Catalyst collapses them into a single Project
    stage1 = {
        "comment_str_only": T.clean_text(text_col),
        "nbr_mentions": T.count_mentions(text_col),
        "is_verified_author": normalise_flag("commenter_verified"),
        "polarity": polarity_expr(T.tokenize(text_col, unicode), lexicon),
        "emojis": E.extract_emojis(text_col),
        "sentiment_emoji": E.emoji_sentiment(text_col, positive, negative, symbol_mode),
    }
    stage2 = {
        "comment_words": T.tokenize("comment_str_only", unicode),
        "label": sentiment_label("polarity"),
        "emojis_count": E.emoji_count_map("emojis"),
        "unique_emoji": E.first_emoji("emojis"),
    }
    stage3 = {
        "comment_words_f": T.remove_stopwords("comment_words"),
        "overall_sentiment": overall_sentiment("sentiment_emoji", "label"),
    }
    order = ["comment_str_only", "nbr_mentions", "is_verified_author", "comment_words", "comment_words_f",
             "polarity", "label", "emojis", "emojis_count", "unique_emoji", "sentiment_emoji",
             "overall_sentiment"]
    out = comments.withColumns(stage1).withColumns(stage2).withColumns(stage3)
    return out.select(*[c for c in comments.columns if c not in order], *order)


def extreme_comments(scored: DataFrame, positive_at: float = 0.75, negative_at: float = -0.5,
                     side: str = "positive") -> DataFrame:
    """Comments with polarity >= positive_at (side='positive') or <= negative_at."""
    cond = F.col("polarity") >= positive_at if side == "positive" else F.col("polarity") <= negative_at
    return scored.where(cond)
