"""Polarity that knows negation and degree words, and a lexicon induced from emoji signs.

Scan.  A text's tokens are folded from left to right with a small state: the sum and
number of polarities met, the product of pending degree words, whether a negation is
pending and how many words it still reaches.  The fold is one native ``aggregate`` over the
token array, so it is row-local and needs no Python.

Lexicon.  Comments with a positive and a negative emoji sign are two corpora; a word's
polarity is its log odds between them under a Dirichlet prior of its share in all comments, kept
where the log odds are several of their standard deviations from 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import POLARITY_LEXICON
from ..session import cut_lineage
from .text import join_by_word

# FIXED VALUES of this library: factors of degree words, and words that negate.
DEGREE_WORDS: dict[str, float] = {
    "absolutely": 1.5, "completely": 1.5, "extremely": 1.5, "highly": 1.3, "incredibly": 1.5, "quite": 1.1,
    "really": 1.3, "so": 1.2, "such": 1.1, "super": 1.4, "too": 1.1, "totally": 1.4, "truly": 1.3, "very": 1.3,
    "barely": 0.5, "fairly": 0.9, "hardly": 0.5, "kinda": 0.7, "little": 0.7, "slightly": 0.6, "somewhat": 0.7,
}
NEGATIONS: tuple[str, ...] = ("cannot", "neither", "no", "nor", "not", "without")
#: A negated polarity is turned round and halved; a pending negation reaches this many plain words.
NEGATED, REACH = -0.5, 3


def scan_tokens(c: Column | str, unicode: bool = False) -> Column:
    """Tokens for the scan: ``tokenize`` with a contracted n't written out as not."""
    text = F.regexp_replace(F.lower(T.null_to_empty(c)), "n['’]t\\b", " not ")
    return T.tokenize(text, unicode)


def scan(marks: Column, reach: int = REACH) -> Column:
    """Polarity of an array of (p double: polarity or null, d double: degree or null, neg boolean).

    * a polarity p counts as p times the pending degrees, or, if a negation is pending,
      as NEGATED * p divided by them ("not very good" is milder than "not good"); it is
      kept within [-1, 1] and clears what was pending;
    * a degree word multiplies the pending degrees; a negation turns the pending negation on or
      off again and reaches ``reach`` plain words;
    * a plain word clears the pending degrees and uses up one word of a negation's reach.

    The result is the mean of the polarities met, 0.0 without any.
    """
    none = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(1.0).alias("mult"),
                    F.lit(False).alias("flip"), F.lit(0).alias("left"))

    def state(total, n, mult, flip, left):
        return F.struct(total.alias("total"), n.alias("n"), mult.alias("mult"), flip.alias("flip"), left.alias("left"))

    def step(s, t):
        value = F.when(s["flip"], F.lit(NEGATED) * t["p"] / s["mult"]).otherwise(t["p"] * s["mult"])
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
        left = s["left"] - 1
        return (F.when(t["p"].isNotNull(), state(s["total"] + value, s["n"] + 1, F.lit(1.0), F.lit(False), F.lit(0)))
                .when(t["d"].isNotNull(), state(s["total"], s["n"], s["mult"] * t["d"], s["flip"], s["left"]))
                .when(t["neg"], state(s["total"], s["n"], s["mult"], ~s["flip"], F.lit(reach)))
                .otherwise(state(s["total"], s["n"], F.lit(1.0), s["flip"] & (left > 0), F.greatest(left, F.lit(0)))))

    return F.aggregate(marks, none, step, lambda s: F.when(s["n"] > 0, s["total"] / s["n"]).otherwise(F.lit(0.0)))


def word_value(word: Column, values: Mapping[str, float]) -> Column:
    """The word's number in a bounded table, else null; the map is probed for its own words only."""
    numbers = T._map_literal({k: float(v) for k, v in values.items()})
    return F.when(word.isin(*sorted(values)), F.element_at(numbers, word))


def polarity_scan(tokens: Column | str, lexicon: Mapping[str, float] = POLARITY_LEXICON,
                  degrees: Mapping[str, float] = DEGREE_WORDS, negations: Iterable[str] = NEGATIONS,
                  reach: int = REACH) -> Column:
    """Polarity of a token array by the scan, with a bounded lexicon; row-local.  A word in several
    of the lists is a lexicon word first, then a degree word.  Null arrays give null."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return scan(F.transform(t, lambda w: F.struct(
        word_value(w, lexicon).alias("p"), word_value(w, degrees).alias("d"), w.isin(*negations).alias("neg"))), reach)


def polarity_scan_by_join(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame, word_col: str = "word",
                          value_col: str = "polarity", out_col: str = "polarity",
                          degrees: Mapping[str, float] = DEGREE_WORDS, negations: Iterable[str] = NEGATIONS,
                          reach: int = REACH) -> DataFrame:
    """(id, out_col) by the scan for a lexicon of any size: distinct rows' tokens join the lexicon
    (salted by the id), come back in order and are scanned.  ``id_col`` must be unique; several
    lexicon rows of one word count as their mean; rows without tokens get 0.0."""
    words = lexicon.select(F.col(word_col).alias("_w"), F.col(value_col).cast("double").alias("_v")) \
        .where("_w IS NOT NULL").groupBy("_w").agg(F.avg("_v").alias("_v"))
    tokens = df.select(id_col, F.posexplode_outer(tokens_col).alias("_at", "_w"))
    marked = join_by_word(tokens, words, "_w", id_col, "left").select(
        id_col, F.when(F.col("_w").isNotNull(), F.struct(
            "_at", F.col("_v").alias("p"), word_value(F.col("_w"), degrees).alias("d"),
            F.col("_w").isin(*negations).alias("neg"))).alias("_m"))
    return marked.groupBy(id_col).agg(F.sort_array(F.collect_list("_m")).alias("_m")) \
        .select(id_col, scan(F.col("_m"), reach).alias(out_col))


def induced_lexicon(scored: DataFrame, words_col: str = "comment_words_f", sign_col: str = "sentiment_emoji",
                    prior: float = 100.0, z_cut: float = 1.96, min_rows: int = 5) -> DataFrame:
    """A lexicon learnt from emoji signs: (word, n_positive, n_negative, log_odds, z, polarity).

    Counted is in how many rows with sign 1 and -1 a word stands.  The log odds of a word between
    both have a Dirichlet prior of ``prior`` pseudo-rows, dealt by the word's share in all rows
    (those without a sign included); z is the log odds over their standard deviation, and words
    with |z| >= z_cut in at least ``min_rows`` rows stay.  polarity = tanh(log_odds / 2), which
    lies in (-1, 1).  Null words and signs count nowhere.  One map-side combined
    aggregate over the words; three totals reach the driver.
    """
    gen, keep = T.explode_values(F.array_distinct(words_col), "word")
    counts = cut_lineage(scored.select(sign_col, gen).where(keep).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(sign_col) == 1).alias("n_positive"),
        F.count_if(F.col(sign_col) == -1).alias("n_negative")))
    total, positive, negative = counts.agg(F.sum("n"), F.sum("n_positive"), F.sum("n_negative")).first()
    if not positive or not negative:
        total, positive, negative = total or 1, positive or 0, negative or 0
    a = F.lit(float(prior)) * F.col("n") / F.lit(float(total))

    def odds(n: str, size: int) -> Column:
        mass = F.col(n) + a
        return F.log(mass / (F.lit(float(size + prior)) - mass))

    return (counts.where(F.col("n") >= min_rows)
            .withColumn("log_odds", odds("n_positive", positive) - odds("n_negative", negative))
            .withColumn("z", F.col("log_odds") / F.sqrt(1 / (F.col("n_positive") + a) + 1 / (F.col("n_negative") + a)))
            .where(F.abs("z") >= z_cut)
            .select("word", "n_positive", "n_negative", "log_odds", "z", F.tanh(F.col("log_odds") / 2).alias("polarity")))
