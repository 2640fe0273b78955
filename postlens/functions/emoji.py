"""Emoji extraction and symbol-list sentiment as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import EMOJI_RANGES, NEGATIVE_SYMBOLS, POSITIVE_SYMBOLS
from .text import null_to_empty, string_array_literal


def emoji_class(ranges: Iterable[tuple[int, int]] = EMOJI_RANGES) -> str:
    """Character class spelled with \\x{...}: identical in Java regex and RE2."""
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def extract_emojis(c: Column | str, ranges: Iterable[tuple[int, int]] = EMOJI_RANGES) -> Column:
    """All emoji code points of the text, in order, as array<string>."""
    return F.regexp_extract_all(null_to_empty(c), F.lit("(" + emoji_class(ranges) + ")"), 1)


def emoji_count_map(emojis: Column | str) -> Column:
    """map<emoji, count> of one row's emoji array, keys in first-seen order."""
    e = F.col(emojis) if isinstance(emojis, str) else emojis
    return F.map_from_entries(F.transform(
        F.array_distinct(e),
        lambda x: F.struct(x.alias("key"), F.size(F.filter(e, lambda y: y == x)).alias("value"))))


def first_emoji(emojis: Column | str) -> Column:
    e = F.col(emojis) if isinstance(emojis, str) else emojis
    return F.try_element_at(e, F.lit(1))


def symbol_array(symbols: Iterable[str]) -> Column:
    """The symbols as one array literal (duplicates need no second test)."""
    return string_array_literal(dict.fromkeys(symbols))


def _any_contains(text: Column, symbols: Iterable[str]) -> Column:
    # one pass over the text for all symbols, each quoted literally
    return text.rlike("|".join(r"\Q" + s + r"\E" for s in dict.fromkeys(symbols)))


def _is_pictograph(s: str) -> bool:
    return not s.isascii() and len(s) == 1


def _any_token(text: Column, symbols: Iterable[str]) -> Column:
    syms = list(dict.fromkeys(symbols))
    pict = [s for s in syms if _is_pictograph(s)]
    emoticons = [s for s in syms if not _is_pictograph(s)]
    parts = []
    if pict:
        parts.append(_any_contains(text, pict))
    if emoticons:
        arr = symbol_array(emoticons)
        parts.append(F.exists(F.split(text, r"\s+"), lambda t: F.array_contains(arr, t)))
    return reduce(lambda a, b: a | b, parts)


def emoji_sentiment(c: Column | str, positive: Iterable[str] = POSITIVE_SYMBOLS,
                    negative: Iterable[str] = NEGATIVE_SYMBOLS, mode: str = "substring") -> Column:
    """1 if any positive symbol occurs, else -1 if any negative, else 0.

    ``mode='substring'`` tests plain containment (so '10:30' contains ':3');
    ``mode='token'`` requires ASCII emoticons to be whole whitespace-separated
    tokens while single-code-point emoji still match anywhere.
    """
    text = null_to_empty(c)
    test = {"substring": _any_contains, "token": _any_token}[mode]
    return (F.when(test(text, positive), F.lit(1))
            .when(test(text, negative), F.lit(-1))
            .otherwise(F.lit(0)))
