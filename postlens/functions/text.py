"""Text column functions: cleaning, character counts, tokens, stop words,
suffix stemming and dictionary lemmas."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import BAD_TOKENS, STOP_WORDS_EN, VERB_LEMMAS

# ASCII punctuation (the 32 characters of Python's string.punctuation) as
# code-point ranges; same spelling works in Java regex and RE2.
PUNCT_CLASS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
DIGITS = r"[0-9]{1,}"
ASCII_NON_WORD = r"\W"
UNICODE_NON_WORD = r"[^\p{L}\p{N}_]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_to_empty(c: Column | str) -> Column:
    """Null text behaves as the empty string (0 mentions, no tokens)."""
    return F.coalesce(_c(c), F.lit(""))


def strip_digits(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), DIGITS, "")


def strip_punct(c: Column | str) -> Column:
    """Remove ASCII punctuation; words around an apostrophe are joined."""
    return F.regexp_replace(_c(c), PUNCT_CLASS, "")


# Digits and ASCII punctuation in one class: removing one kind can never
# create a match of the other, so one pass equals digits-then-punctuation.
DIGITS_OR_PUNCT = r"[0-9\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def clean_text(c: Column | str) -> Column:
    """Digits and punctuation removed (one regex pass), null read as ''."""
    return F.regexp_replace(null_to_empty(c), DIGITS_OR_PUNCT, "")


def count_substring(c: Column | str, s: str) -> Column:
    """Occurrences of literal ``s`` (non-overlapping); 0 for null text."""
    t = null_to_empty(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)).cast("int")


def has_substring(c: Column | str, s: str) -> Column:
    return (F.instr(null_to_empty(c), s) > 0).cast("int")


def count_mentions(c: Column | str) -> Column:
    """Number of '@' (an e-mail address counts as a mention)."""
    return count_substring(c, "@")


def has_mention(c: Column | str) -> Column:
    return has_substring(c, "@")


def has_hashtag(c: Column | str) -> Column:
    return has_substring(c, "#")


def tokenize(c: Column | str, unicode: bool = False) -> Column:
    """Lower-case and split on non-word characters, dropping empty tokens.

    ``unicode=False`` splits on ASCII ``\\W`` (so accented letters split
    words); ``unicode=True`` keeps letters of any script together.
    """
    pattern = UNICODE_NON_WORD if unicode else ASCII_NON_WORD
    return F.filter(F.split(F.lower(null_to_empty(c)), pattern), lambda x: F.length(x) > 0)


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_values(values: Iterable[str]) -> str:
    return ", ".join(sql_str(v) for v in values)


def remove_stopwords(tokens: Column | str, stop_words: Iterable[str] = STOP_WORDS_EN) -> Column:
    """Case-insensitive stop-word filter that keeps duplicates and order.

    For a named column the filter is written as one SQL expression (parsed
    on the JVM side in one call); Catalyst turns the IN list into a hash set
    either way."""
    stop = sorted({w.lower() for w in stop_words})
    if isinstance(tokens, str):
        return F.expr(f"filter(`{tokens}`, w__ -> NOT lower(w__) IN ({_sql_values(stop)}))")
    return F.filter(_c(tokens), lambda x: ~F.lower(x).isin(*stop))


_SEP = "\u0001"


def string_array_literal(values: Iterable[str]) -> Column:
    """An array<string> literal from one packed string literal (two JVM calls
    however long the list; the optimizer folds the split to a constant)."""
    vals = list(values)
    assert all(_SEP not in v for v in vals)
    return F.split(F.lit(_SEP.join(vals)), _SEP)


def _map_literal(d: Mapping[str, object]) -> Column:
    """map<string, string|double> literal built from two packed arrays."""
    items = sorted(d.items())
    keys = string_array_literal(k for k, _ in items)
    if all(isinstance(v, str) for _, v in items):
        return F.map_from_arrays(keys, string_array_literal(v for _, v in items))
    return F.map_from_arrays(keys, string_array_literal(repr(float(v)) for _, v in items).cast("array<double>"))


def lemmatise(tokens: Column | str, dictionary: Mapping[str, str] = VERB_LEMMAS,
              drop: Iterable[str] = BAD_TOKENS) -> Column:
    """Dictionary lemmas, de-duplicated per row and sorted.

    Tokens in ``drop`` are removed, each remaining token is replaced by its
    base form when the dictionary knows it, and the distinct results are
    returned in sorted order (a set, made deterministic).  The dictionary is a
    bounded literal map, so this is a row-local expression with no shuffle;
    see ``operators.text.normalise_vocabulary`` for dictionaries given as tables.
    """
    keys = sorted(dictionary)
    bad = list(drop)
    if isinstance(tokens, str):
        kept = f"filter(`{tokens}`, w__ -> NOT w__ IN ({_sql_values(bad)}))" if bad else f"`{tokens}`"
        pairs = ", ".join(f"{sql_str(k)}, {sql_str(dictionary[k])}" for k in keys)
        return F.expr(f"sort_array(array_distinct(transform({kept}, w__ -> CASE WHEN w__ IN "
                      f"({_sql_values(keys)}) THEN element_at(map({pairs}), w__) ELSE w__ END)))")
    m = _map_literal(dictionary)
    kept = F.filter(_c(tokens), lambda x: ~x.isin(*bad)) if bad else _c(tokens)
    # hash-set membership first (InSet); the map, whose lookup scans its keys,
    # is probed only for words that are in it
    lemmas = F.transform(kept, lambda x: F.when(x.isin(*keys), F.element_at(m, x)).otherwise(x))
    return F.sort_array(F.array_distinct(lemmas))


def verb_base(word: Column | str, dictionary: Mapping[str, str] = VERB_LEMMAS) -> Column:
    """Base form of one word: the dictionary's, else the regular ending taken off.
    -ies and -ied become -y; -ing, -ed and -s go where at least three letters stay
    that hold a vowel; a consonant doubled before -ing or -ed is single again (not
    l, s or z)."""
    w = _c(word)
    keys = sorted(dictionary)
    stem = (F.when(w.rlike(r"^.{2,}(ies|ied)$"), F.regexp_replace(w, r"(ies|ied)$", "y"))
            .when(w.rlike(r"^.{3,}(ing|ed)$") & w.rlike(r"[aeiouy].*(ing|ed)$"),
                  F.regexp_replace(F.regexp_replace(w, r"(ing|ed)$", ""), r"([bdfgmnprt])\1$", "$1"))
            .when(w.rlike(r"^.{2,}(ss|sh|ch|x)es$"), F.regexp_replace(w, r"es$", ""))
            .when(w.rlike(r"^.{2,}[^sui]s$"), F.regexp_replace(w, r"s$", ""))
            .otherwise(w))
    return F.when(w.isin(*keys), F.element_at(_map_literal(dictionary), w)).otherwise(stem)


def explode_values(arr: Column | str, name: str) -> tuple[Column, Column]:
    """(generator, keep-condition) for exploding an array or map whose
    elements are computed by a costly expression.

    A plain ``explode`` makes the optimizer infer ``size(arr) > 0`` and push
    it towards the scan, which evaluates the costly expression a second time
    per row; ``explode_outer`` infers nothing, and the empty-array rows it
    emits are dropped by the returned condition instead."""
    return F.explode_outer(arr).alias(name), F.col(name).isNotNull()


def n_distinct_words(tokens: Column | str) -> Column:
    return F.size(F.array_distinct(_c(tokens)))


# Suffix rules for the light stemmer, applied in order; the first rule whose
# pattern matches rewrites the word.  Steps follow the shape of Porter's
# steps 1a-1c and the most frequent step 2/3 suffixes.
STEM_RULES: tuple[tuple[str, str, str], ...] = (
    # (step, regex on the word, replacement)
    ("1a", r"sses$", "ss"),
    ("1a", r"ies$", "i"),
    ("1a", r"([^s])s$", "$1"),
    ("1b", r"([aeiouy].*)eed$", "$1ee"),
    ("1b", r"([aeiouy].*)ed$", "$1"),
    ("1b", r"([aeiouy].*)ing$", "$1"),
    ("1c", r"([aeiouy].+)y$", "$1i"),
    ("2", r"ational$", "ate"),
    ("2", r"tional$", "tion"),
    ("2", r"ization$", "ize"),
    ("2", r"iveness$", "ive"),
    ("2", r"fulness$", "ful"),
    ("2", r"ousness$", "ous"),
    ("3", r"icate$", "ic"),
    ("3", r"alize$", "al"),
    ("3", r"ness$", ""),
)


STEM_STEPS = ("1a", "1b", "1c", "2", "3")


def _literal_suffix(pattern: str) -> str:
    """'([aeiouy].*)ing$' -> 'ing': the fixed letters a rule's match ends with."""
    tail = re.search(r"([a-z]+)\$$", pattern)
    return tail.group(1) if tail else ""


def stem_step(x: Column, step: str) -> Column:
    """One step group: the first matching rule rewrites the word."""
    expr = None
    for s, p, r in STEM_RULES:
        if s != step:
            continue
        # the literal ending is tested first (cheap); the regex only runs on
        # words that already have it
        cond = x.endswith(_literal_suffix(p)) & x.rlike(p)
        val = F.regexp_replace(x, p, r)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(x)


def stem_tokens(tokens: Column | str, min_len: int = 3) -> Column:
    """Stem every token, drop stems shorter than ``min_len``; keeps order and
    duplicates.  Each step is its own array transform, so every step reads
    the previous step's result once instead of re-deriving it."""
    def step_fn(step):
        return lambda x: stem_step(x, step)
    out = _c(tokens)
    for step in STEM_STEPS:
        out = F.transform(out, step_fn(step))
    return F.filter(out, lambda s: F.length(s) >= min_len)
