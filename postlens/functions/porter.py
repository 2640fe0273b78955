"""Porter's suffix stripping as native column expressions, one projection a step.

A y that counts as a consonant (at the start, or behind a vowel) is written Y while the steps run,
so vowels are the class [aeiouy] and the measure m of a stem, the number of its vowel-consonant
turns, is one pattern count.  Meant for the distinct words of a corpus, whose stems are then joined
back (``operators.text.vocabulary_stems``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = Callable[[Column], Column]


def measure(stem: Column) -> Column:
    """Vowel-consonant turns of a stem with marked consonant ys."""
    return F.regexp_count(stem, F.lit("[aeiouy]+[^aeiouy]+"))


def over(m: int) -> Condition:
    return lambda stem: measure(stem) > m


def has_vowel(stem: Column) -> Column:
    return stem.rlike("[aeiouy]")


def ends_doubled(x: Column) -> Column:
    return x.rlike("([^aeiouy])\\1$")


def ends_short(x: Column) -> Column:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return x.rlike("[^aeiouy][aeiouy][^aeiouywxY]$")


def head(x: Column, n: int) -> Column:
    """x without its last n letters."""
    return F.substring(x, F.lit(1), F.length(x) - n)


def always(stem: Column) -> Column:
    return F.lit(True)


def first_ending(x: Column, rules: list[tuple[str, str, Condition]]) -> Column:
    """The rule with the longest ending that x has decides: x with the ending replaced if the stem
    before it meets the rule's condition, else x as it is."""
    out = None
    for ending, to, holds in sorted(rules, key=lambda r: -len(r[0])):
        stem = head(x, len(ending))
        done = F.when(holds(stem), F.concat(stem, F.lit(to))).otherwise(x)
        out = F.when(x.endswith(ending), done) if out is None else out.when(x.endswith(ending), done)
    return out.otherwise(x)


# FIXED VALUES: the endings of the published algorithm, by step.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
          "ous", "ive", "ize"]


def repaired(x: Column) -> Column:
    """What is left when -ed or -ing has gone: an e again, or one consonant less."""
    return (F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e")))
            .when(ends_doubled(x) & ~x.rlike("[lsz]$"), head(x, 1))
            .when((measure(x) == 1) & ends_short(x), F.concat(x, F.lit("e"))).otherwise(x))


def with_stems(words: DataFrame, word_col: str = "word", stem_col: str = "stem") -> DataFrame:
    """The table with the stem of each lower-case word; words of up to two letters and null stay."""
    w = "_porter"
    x = F.col(w)
    taken = F.when(x.endswith("eed"), F.lit("eed")).when(x.endswith("ed") & has_vowel(head(x, 2)), F.lit("ed")) \
        .when(x.endswith("ing") & has_vowel(head(x, 3)), F.lit("ing"))
    bare = F.when(F.col("_cut") == "eed", F.when(measure(head(x, 3)) > 0, head(x, 1)).otherwise(x)) \
        .when(F.col("_cut") == "ed", head(x, 2)).when(F.col("_cut") == "ing", head(x, 3)).otherwise(x)
    in_ion = lambda stem: (measure(stem) > 1) & stem.rlike("[st]$")
    steps: list[tuple[str, Column]] = [
        (w, F.regexp_replace(F.col(word_col), "(^|[aeiouy])y", "$1Y")),
        (w, first_ending(x, [(e, to, always) for e, to in PLURALS])),
        ("_cut", taken),
        (w, bare),
        (w, F.when(F.col("_cut").isin("ed", "ing"), repaired(x)).otherwise(x)),
        (w, F.when(x.rlike("[yY]$") & has_vowel(head(x, 1)), F.concat(head(x, 1), F.lit("i"))).otherwise(x)),
        (w, first_ending(x, [(e, to, over(0)) for e, to in STEP_2])),
        (w, first_ending(x, [(e, to, over(0)) for e, to in STEP_3])),
        (w, first_ending(x, [(e, "", in_ion if e == "ion" else over(1)) for e in STEP_4])),
        (w, F.when(x.endswith("e") & ((measure(head(x, 1)) > 1) | ((measure(head(x, 1)) == 1) & ~ends_short(head(x, 1)))),
                   head(x, 1)).otherwise(x)),
        (w, F.when(x.endswith("ll") & (measure(x) > 1), head(x, 1)).otherwise(x)),
    ]
    out = words
    for name, expr in steps:
        out = out.withColumn(name, expr)
    return out.withColumn(stem_col, F.when(F.length(word_col) <= 2, F.col(word_col)).otherwise(F.lower(w))).drop(w, "_cut")
